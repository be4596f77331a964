"""Problem 2: statistics of texts that tell running prose from lists, tables and junk.

Method: gradient-boosted trees over document statistics. Labels are weak and come of evidence that the trees
don't see: the form of each line (records, items of lists, damaged, repeated or unspeakable words on one side,
closed sentences of some length on the other). Documents that are nearly all of one kind become examples,
together with a few fixed texts (`SEEDS`). The trees see word counts and lengths, shares of symbols, digits,
letters and capitals, closed lines and common words; they alone decide. They are fitted on a bounded sample
(`SAMPLE_ROWS`) and their probabilities calibrated on texts checked by hand (`HOLDOUT`) that are never in the fit.
Statistics are taken of the main body: page furniture (problem 7) and messages of problem 6 are left aside, so
that neither makes a text junk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from tabbyline.llm.encode import slices
from tabbyline.llm.furniture import furniture, has_running_text, without
from tabbyline.llm.residue import is_filler, residue_messages
from tabbyline.llm.trees import BoostedTrees
from tabbyline.session import ensure_shipped, materialise

SAMPLE_ROWS = 16_384
#: So many rows each seed counts as, against the sampled ones.
SEED_WEIGHT = 16
#: Share of a body that must show one kind for a weak label.
SURE_SHARE = 0.55

#: Frequent function words of the corpus' languages (fixed values).
COMMON = frozenset(
    "the a an of to and in is it its that for with on as at by from be are was were or but not this these which when than then has have had can may"
    " should will would who what how they their there if so do does did been before after about into more most some any each other also only you your we our"
    " el la los las un una de del que y en no se por con para su es al lo como más o fue ha esta este cuando muy sin sobre entre desde"
    " le les des du et est dans pour qui une sur pas ne au aux ce cette sont avec par plus son sa il elle on ou mais a été à d l"
    " der die das und ist ein eine einen einer den dem des zu von mit für auf nicht sich im am wurde werden wird bei nach aus auch oder als wie man dass ihr"
    " и в не на что с по это как у из за от к его её но а же был была при для или если до после когда чтобы уже со он она они их него неё там так ещё только этот эта эти можно надо"
    " sie er wir hat haben war waren kann wenn ohne unter dann ils elles leur fait peut quand bien son están está han hay puede si porque".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTERS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha()})
_HIRAGANA = re.compile(r"[ぁ-ゟ]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_BULLET = re.compile(r"^(?:[-*+•·–—▪]|\d{1,4}[.)]|\(\d{1,3}\))\s")
_FIELDS = re.compile(r"\w+: [^;]+; \w+: ")
_DATED = re.compile(r"\d{4}-\d\d-\d\d")
_SETTING = re.compile(r"\w=\S")
#: A sign inside a word, and a digit inside a word; the sign is tried first, so that letters are skipped.
_BROKEN = (
    re.compile(r"[^\w\s'’.,:;()\"“”‘/&·-](?<=[^\W\d_].)(?=[^\W\d_])"),
    re.compile(r"\d(?<=[^\W\d_]\d)(?=[^\W\d_])"),
)
#: Endings of Japanese sentences.
_POLITE = re.compile("です|ます|ました|ません|でした")
_VOWEL = re.compile(r"[aeiouy]")
_CLOSED = tuple(".!?…。！？\"”’»」")

NAMES = (
    "log_words", "word_length", "symbol_share", "digit_share", "closed_lines", "common_words", "words_a_line",
    "capital_words", "long_words", "hiragana_share", "letter_share", "closed_share", "distinct_words",
    "prose_evidence", "junk_evidence", "lines",
)


#: What the trees see: all but what the labels come of.
SEEN = [n for n, name in enumerate(NAMES) if name not in ("capital_words", "distinct_words", "prose_evidence", "junk_evidence", "lines")]


def _words(line: str) -> list[str]:
    """Runs of letters in lower case."""
    return line.lower().translate(_NO_LETTERS).split() if line.isascii() else _WORD.findall(line.lower())


def _broken(text: str) -> int:
    """How many signs and digits stand inside of words."""
    return sum(len(p.findall(text)) for p in _BROKEN)


def _is_record(line: str) -> bool:
    """Table rows, objects, addresses of the web, fields, settings and log lines."""
    return (
        line[0] in "|[{"
        or "\t" in line
        or line.startswith("http")
        or line.count("|") > 1 and not line.endswith(_CLOSED)
        or "; " in line and ": " in line and bool(_FIELDS.search(line))
        or "=" in line and bool(_SETTING.search(line)) and not line.endswith(_CLOSED)
        or line[0].isdigit() and bool(_DATED.match(line))
    )


def _evidence(line: str, words: list[str], names: float, damaged: bool) -> int:
    """1 if the form of a line shows that it is no prose, 0 if it shows prose, -1 if it doesn't tell. `names`: the share
    of its tokens that begin with a capital."""
    closed = line.endswith(_CLOSED)
    if not line.isascii() and 2 * (wide := len(_WIDE.findall(line))) > len(line):
        return 0 if wide >= 8 and (closed or _POLITE.search(line)) else -1
    if _is_record(line) or not closed and _BULLET.match(line) or damaged and _broken(line) > 0.03 * len(line):
        return 1
    count = len(words)
    if 2 * sum(map(len, words)) < len(line) - line.count(" "):
        return 1
    if count < 8:
        return -1
    if names >= 0.8:
        return 1
    if closed:
        return 0 if names <= 0.5 else -1
    # words said again within sixteen, which keywords do
    spans = ([w for w in words[at : at + 16] if len(w) > 3] for at in range(0, count, 16))
    repeated = sum(len(span) - len(set(span)) for span in spans) / count
    if repeated >= 0.15 or sum(1 for w in words if len(w) > 2 and w.isascii() and not _VOWEL.search(w)) >= 0.3 * count:
        return 1
    return 0 if repeated < 0.1 and names <= 0.35 and count >= 12 else -1


def _weight(line: str) -> int:
    """Length of a line, a character of a wide script counting as three letters."""
    return len(line) if line.isascii() else len(line) + 2 * len(_WIDE.findall(line))


def main_text(content: str, title: str | None) -> str:
    """The body without furniture, without the page's heading and without messages of problem 6."""
    body = without(content, furniture(content, title))
    told = residue_messages(body)
    if told:
        for message in told:
            body = body.replace(message, "")
        if any("ipsum" in m.lower() for m in told):
            body = "\n".join(line for line in body.split("\n") if not is_filler(line))
        if not has_running_text(body):
            return ""  # what is left of an error page
    if title and title.strip():
        own = " ".join(title.split()).lower()
        body = "\n".join(line for line in body.split("\n") if len(line) > len(own) + 20 or " ".join(line.split()).lower() != own)
    return body


def statistics(body: str) -> list[float]:
    """The statistics of `NAMES` of a body of text; zeros for one without any visible character."""
    lines = [line for line in (raw.strip() for raw in body.split("\n")) if line]
    if not lines:
        return [0.0] * len(NAMES)
    text = "\n".join(lines)
    split = [line.split() for line in lines]
    capitals = [sum(map(str.isupper, [t[0] for t in tokens])) for tokens in split]
    count = sum(map(len, split))
    solid = sum(len("".join(tokens)) for tokens in split)
    damaged = _broken(text) > 0.005 * solid
    words_of = list(map(_words, lines))
    weights = [0, 0, 0]  # of lines of prose, of junk, and those that don't tell
    closed = closed_weight = 0
    for line, words, tokens, capital in zip(lines, words_of, split, capitals):
        weight = _weight(line)
        weights[_evidence(line, words, capital / len(tokens), damaged)] += weight
        if line.endswith(_CLOSED):
            closed += 1
            closed_weight += weight
    words = list(chain.from_iterable(words_of))
    letters = sum(map(len, words))
    kinds = set(words)
    wide = len(_WIDE.findall(text)) if not text.isascii() else 0
    digits = sum(map(text.count, "0123456789"))
    n, m, total = max(1, len(words)), len(lines), sum(weights)
    return [
        float(np.log1p(len(words) + wide / 2)),
        min(20.0, letters / n),
        (solid - letters - digits) / solid,
        digits / solid,
        closed / m,
        sum(map(COMMON.__contains__, words)) / n,
        (len(words) + wide / 2) / m,
        sum(capitals) / count,
        sum(n for n in map(len, kinds) if n > 22) / solid if not wide else 0.0,
        len(_HIRAGANA.findall(text)) / max(1, wide) if wide else 0.0,
        letters / solid,
        closed_weight / total,
        len(kinds) / n,
        weights[0] / total,
        weights[1] / total,
        float(m),
    ]


def weak_label(stats: list[float]) -> int:
    """1 for structural junk, 0 for prose, -1 if the forms of the lines don't tell. A single line of a few words,
    which is neither a list nor a table, is an example of prose."""
    prose, junk, lines = stats[-3:]
    if not lines:
        return -1
    if lines == 1 and junk == 0 and stats[0] < np.log1p(10):
        return 0
    return 0 if prose >= SURE_SHARE else 1 if junk >= SURE_SHARE else -1


#: Texts that are examples in every fit, whatever the table: prose, then structural junk.
SEEDS = (
    (
        "She was found near the road with a broken leg, and nobody knew how long she had been there.\nAfter the operation she had to rest for six weeks.",
        "there is no reason to change the food of an old cat as long as it eats well and keeps its weight",
        "My cat does not like the carrier. What can I do so that he goes in by himself?",
        "The coat of this breed is short and needs little care. It is a quiet cat that likes warm places and gets on with dogs.",
        "El veterinario dijo que no era grave y que con la dieta nueva iba a mejorar en pocos días.",
        "los gatos mayores duermen más y por eso hay que mirar bien si comen y beben como siempre",
        "Il faut brosser ce chat une fois par semaine, car son poil est long et se mêle vite.",
        "Nach der Untersuchung war klar, dass die Niere krank ist und die Katze eine Diät braucht.",
        "die tierärztin hat gesagt dass wir noch eine woche warten sollen bevor wir wieder kommen",
        "Врач сказал, что это не опасно и что через неделю кошка будет есть как раньше.",
        "кошка пришла домой только вечером и не стала есть хотя была очень голодна",
        "врач посмотрел её зубы и сказал что всё хорошо но корм надо сменить",
        "この猫は年をとってから水を多く飲むようになりました。早めに病院へ行きましょう。",
        "この猫は年をとってから水を多く飲むようになりました早めに病院へ行きましょう",
        "子猫は一日に何度も少しずつ食べるのがよいですが太りすぎには気をつけてください夜はよく眠ります",
        "Luna (Leeds), asthma",
        "Oscar, home of York: a cold",
    ),
    (
        "Name\tTown\tkg\tmg\nOscar\tYork\t4.2\t11\nBella\tBath\t3.9\t10\nLeo\tHull\t5.5\t14",
        "| Oscar | York | 11 mg |\n| Bella | Bath | 10 mg |\n| Leo | Hull | 14 mg |\n| Daisy | Ely | 9 mg |",
        '{"cat": "Oscar", "mg": 11}\n{"cat": "Bella", "mg": 10}\n{"cat": "Leo", "mg": 14}\n{"cat": "Daisy", "mg": 9}',
        "* Oscar fish broth, York\n* Bella raw duck, Bath\n* Leo dry food, Hull\n* Daisy egg yolk, Ely\n* Max tuna, Deal",
        "1. Oscar (Birman, red) Taylor\n2. Bella (Ragdoll, blue) Walker\n3. Leo (Burmese, cream) Hughes\n4. Daisy (Sphynx, black) Foster",
        "vet cats buy cheap feline toy cat kitten food best cheap vet price buy cats toy feline kitten best",
        "Oscar Bella Leo Daisy Max Ruby Toby, Misty, Sooty, Ginger, Poppy, Jasper, Rosie, Alfie, Tigger, Molly",
        "3.11 84.20 19.73 402.5 66.10 7.98 51.2\n90.4 12.7 33.9 28.55 71.03 64.2 18.8\n5.01 47.6 83.3 29.1 10.7 94.4 36.2",
        "2023-02-11 10:02 [INFO] door-3 oscar=4.2\n2023-02-11 10:07 [WARN] door-1 bella=3.9\n2023-02-12 08:44 [INFO] door-3 leo=5.5",
        "https://paws.example/x/oscar-9\nhttps://paws.example/x/bella-3\nhttps://paws.example/y/leo-4\nhttps://paws.example/y/daisy-8",
        "Owner: Ann Taylor; Colour: red; Weight: 4.2\nDam: Ruby Foster; Coat: long; Weight: 3.1\nSire: Max Hughes; Colour: blue; Weight: 5.0",
        "%*#~+/=|<>$§^°_*#%|~+=/\\<>$§@^°_~*#+%=|/<>$ §^°_@*#~+%=\\|/<>$§^",
        "QmFzZTY0IGxpbmUgb2YgdGV4dA8ZGF0YTEyMzQ1Njc4OTBhYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5eg0KQUJDREVGR0hJ",
        "wqrtp zxcvb nmlkj fghjk plmnb vcxzs dfghj kqwrt ypsdf ghjkl zxcmn bvqwr tpsdf jklzx cvbnm",
        "{h' ;at }as {|und l{1e in t^e `veni!g an} did' n;t w{nt to l;ave t{e ho`s} a{ai!",
        "Taylor & Co, 8 Church Street, York\nWalker Pets, 15 Mill Road, Bath\nHughes Vets, 2 Castle Lane, Hull\nFoster Cats, 31 Bridge End, Ely",
    ),
)


#: Texts checked by hand: prose, then structural junk.
HOLDOUT = (
    (
        "The kitten slept on the sofa all day and did not want to eat. In the evening it was better.",
        "Cats that drink a lot should be seen by a vet, because the kidneys may be the reason",
        "we do not know why she hides under the bed but it began after the move to the new flat",
        "My neighbour says: brush the coat every day, or it will mat. I think that she is right!",
        "El gato no quiere comer desde ayer y se esconde. La dueña lo llevó a la clínica por la tarde.",
        "la gata bebe mucha agua y duerme poco por eso conviene pedir cita con el veterinario",
        "Le chat est malade depuis lundi et il ne mange plus. Il faut le montrer au vétérinaire.",
        "le refuge a vu que la chatte boit plus et il a appelé la clinique dans la journée",
        "Die Katze hat nicht gefressen und wurde in der Praxis untersucht. Nach zwei Tagen ging es ihr besser.",
        "man sollte die katze nicht allein lassen wenn sie krank ist und sich versteckt",
        "Кошка не ест и прячется под кроватью. После визита к врачу ей стало лучше.",
        "если кошка много пьёт то её нужно показать врачу в тот же день",
        "猫が水をよく飲むようになり、すぐに病院で検査を受けました。今は元気になっています。",
        "この品種は静かで人が好きですが、長い留守番は苦手です。毎日ブラシをかけてください。",
        "These were fed:\n- wet food in the morning\n- dry food at night\nAll of them did well, and the owners were happy with the result of the study.",
        "There is a list of doses below, but ask first, since the dose depends on the weight of the cat.\nkg\tmg\n2\t5\n4\t10\nNever give more than that.",
    ),
    (
        "Milo\tHome\t12\t3.4\tblack\nLuna\tTown\t9\t4.1\twhite\nSimba\tFarm\t31\t5.0\ttabby\nNala\tHome\t4\t2.2\tgrey",
        "| Milo | Home | 3.4 kg | 12 mg |\n| Luna | Town | 4.1 kg | 15 mg |\n| Nala | Farm | 2.2 kg | 8 mg |",
        '{"id": 12, "cat": "Milo", "kg": 3.4}\n{"id": 13, "cat": "Luna", "kg": 4.1}\n{"id": 14, "cat": "Nala", "kg": 2.2}',
        "- Milo wet food, Boston\n- Luna dry kibble, Leeds\n- Nala egg yolk, Turin\n- Simba goat milk, Paris\n- Coco raw rabbit, Porto",
        "1. Milo (Siamese, black) Smith\n2. Luna (Persian, white) Jones\n3. Nala (Manx, tabby) Brown\n4. Coco (Bengal, grey) White",
        "cat food buy cheap kitten toys best cat food online cat bed cheap vet cat tree best price kitten food",
        "Milo Luna Nala Simba Coco Felix Oscar Tiger, Smokey, Shadow, Oreo, Charlie, Max, Leo, Chloe, Bella, Lucy",
        "12.4 88.1 903.2 44.0 17.5 61.8 33.3\n71.1 29.8 10.4 55.5 92.6 80.2 11.9\n14.1 12.8 99.3 20.0 47.4 31.5 63.0",
        "2024-01-08 09:57 [WARN] feeder-6 milo=10.2\n2024-04-26 01:22 [DEBUG] feeder-8 luna=5.9\n2024-06-13 16:00 [INFO] feeder-2 nala=5.9",
        "https://cats.example/a/milo-1\nhttps://cats.example/a/luna-2\nhttps://cats.example/b/nala-3\nhttps://cats.example/c/coco-4",
        "Name: Milo Smith; Colour: black; Weight: 3.4\nDam: Luna Jones; Coat: white; Weight: 4.1\nSire: Leo Brown; Colour: grey; Weight: 5.5",
        "+§#@|¤@°=°<¤/@$+|<>_/^_#~$/$^°=°@%=+ %*°&%/<*=^@_§_*%/=&~~<%>+#+$|$^¤ &=*#\\|~°&<#^<",
        "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9v8YmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4",
        "szjvv gpmkv kksfi fradq zdk eeuax jhgbe dpfx bznys afjxi mjcm emzeh dvfha npqe jfsva tox gozub rmq",
        "T;e ^`|er;of 'uac f!{{t n{ti^'!;{^}|i{g af;;r na1s ab|;|l6 w}1~' }e^r| |h1 !{sit to `ll ^{i~;0} !ae{{l^ou~^ ~b}t t``;blad0",
        "Smith & Sons, 12 Mill Lane, Leeds\nJones Pets, 4 High Street, York\nBrown Vets, 77 Old Road, Bath\nWhite Cats, 9 Park Row, Hull",
    ),
)


def _examples(texts: tuple[tuple[str, ...], tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    prose, junk = texts
    rows = [statistics(t) for t in (*prose, *junk)]
    return np.array(rows, np.float32), np.array([0] * len(prose) + [1] * len(junk), float)


def document_statistics(df: DataFrame, key: str = "id", text: str = "content", title: str = "title") -> DataFrame:
    """`(key, words, chars, stats, label)` for each row: words of the whole text, characters and statistics
    of its main body, and the weak label. Null texts have null statistics. Narrow."""
    ensure_shipped(df.sparkSession)
    schema = StructType(
        [
            StructField("k", df.schema[key].dataType),
            StructField("words", LongType()),
            StructField("chars", LongType()),
            StructField("stats", ArrayType(FloatType())),
            StructField("label", IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                words, chars, stats, labels = [], [], [], []
                for content, head in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if content is None:
                        row = (None, None, None, None)
                    else:
                        body = main_text(content, head)
                        row = (len(content.split()), len(body.strip()), statistics(body), 0)
                        row = (*row[:3], weak_label(row[2]))
                    for column, value in zip((words, chars, stats, labels), row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(words, pa.int64()),
                        pa.array(chars, pa.int64()),
                        pa.array(stats, pa.list_(pa.float32())),
                        pa.array(labels, pa.int32()),
                    ],
                    schema.names,
                )

    chosen = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(title).cast("string").alias("h"))
    return chosen.mapInArrow(run, schema)


def fit(measured: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Trees fitted on the seeds and at most `sample_rows` weakly labelled rows, drawn by the hash of the key, half
    of them of each label as far as there are such, and calibrated on the holdout, which the fit never sees."""
    labelled = measured.filter(F.col("label") >= 0).select("label", "stats", F.xxhash64("k").alias("h"))
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    seeds, truth = _examples(SEEDS)
    rows, labels = [seeds] * SEED_WEIGHT, [truth] * SEED_WEIGHT
    for label, size in sorted(sizes.items()):
        # by the hash first, so that about as many rows leave the executors as are wanted
        near = F.pmod("h", F.lit(1 << 31)) < int(min(1.0, 1.2 * (sample_rows // 2) / size) * (1 << 31))
        drawn = labelled.filter((F.col("label") == label) & near).orderBy("h").limit(sample_rows // 2).toPandas()
        if len(drawn):
            rows.append(np.stack(drawn["stats"].to_numpy()))
            labels.append(drawn["label"].to_numpy(float))
    held, checked = _examples(HOLDOUT)
    return BoostedTrees(rounds=120).fit(np.concatenate(rows).astype(np.float32)[:, SEEN], np.concatenate(labels)).calibrate(held[:, SEEN], checked)


def scored(df: DataFrame, key: str = "id", text: str = "content", title: str = "title", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`(key, words, chars, stats, junk_probability)`; the probability is null for null texts and 0 for bodies
    without any visible character."""
    measured = materialise(document_statistics(df, key, text, title), "statistics")
    model = fit(measured, sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            known = batch["stats"].notna().to_numpy()
            p = np.full(len(batch), np.nan)
            if known.any():
                x = np.stack(batch["stats"][known].to_numpy()).astype(np.float32)
                p[known] = np.where(x[:, NAMES.index("lines")] == 0, 0.0, model.probability(x[:, SEEN]))
            out = batch.assign(junk_probability=p)
            out["junk_probability"] = out["junk_probability"].astype(object).where(known, None)
            yield out

    schema = StructType([*measured.drop("label").schema.fields, StructField("junk_probability", DoubleType())])
    return measured.drop("label").mapInPandas(run, schema).withColumnRenamed("k", key)


def not_prose(df: DataFrame, key: str = "id", least: float = 0.5, **options) -> DataFrame:
    """Keys of texts whose main body is for the most part no running language, each once. Null keys and
    null texts are no case."""
    found = scored(df, key, **options).filter(F.col("junk_probability") >= least)
    return found.filter(F.col(key).isNotNull()).select(key).distinct()


def quality_table(df: DataFrame, key: str = "id") -> DataFrame:
    """The statistics of each row in columns, beside the stored word count of the metadata."""
    stored = df.select(F.col(key), F.col("metadata.word_count").alias("stored_word_count")).groupBy(key).agg(F.max("stored_word_count").alias("stored_word_count"))
    table = scored(df, key).withColumnRenamed("words", "word_count").dropDuplicates([key])
    shares = [F.round(F.col("stats")[NAMES.index(n)].cast("double"), 4).alias(n) for n in NAMES[1:] if n != "lines"]
    return table.select(key, "word_count", *shares, F.round("junk_probability", 4).alias("junk_probability")).join(stored, key, "left")
