"""Problems 10, 7, 6, 3 and 2 on crafted texts."""

import random

import pytest
from pyspark.sql import functions as F

from tabbyline.llm import furniture, lookalike, quality, repeated, residue


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Ｆｕｌｌ，", "Full,", True), ("é", "é", True), ("ﬁn", "fin", True), ("a b c", "a b c", True), ("ca​t­", "cat", True),
        ("саt", "cat", True), ("ΑΒ", "AB", True), ("ё", "ë", True), ("が", "が", True), ("a\r\nb", "a\nb", True), ("Å", "Å", True),
        ("é", "e", False), ("A", "a", False), ("0", "O", False), ("½", "1/2", False), ("x²", "x2", False), ("a  b", "a b", False), ("ø", "o", False), ("ı", "i", False),
        ("👩‍⚕️", "👩⚕️", False), ("a‍b", "ab", True), ("a\ufe0f", "a", True), ("❤\ufe0f", "❤", False), ("1\ufe0f\u20e3", "1\u20e3", False), ("Ӏ", "I", True), ("օ", "o", True), ("ɑ", "a", True), ("ꓮ", "A", True),
        ("\u09c7\u09be", "\u09cb", True), ("ϒ", "Y", True), ("\ue0fe", "\u200d", False), ("ﾏ", "マ", True), ("q̣̇", "q̣̇", True),
    ],
)
def test_lookalikes(a, b, same):
    assert (lookalike.canonical(a) == lookalike.canonical(b)) is same


def test_form_is_stable():
    rng = random.Random(1)
    chars = "ab é́̈​‍️❤👩Ａﬃаеё゙か \r\n가가"
    for _ in range(2000):
        once = lookalike.canonical("".join(rng.choice(chars) for _ in range(rng.randint(0, 12))))
        assert lookalike.canonical(once) == once
    assert lookalike.canonical(None) is None and lookalike.canonical("") == ""


def test_all_characters_have_one_stable_form():
    import unicodedata

    for code in range(0x30000):
        if not 0xD800 <= code < 0xE000:
            ch = chr(code)
            form = lookalike.canonical(f"a{ch}b")
            assert lookalike.canonical(form) == form and unicodedata.is_normalized("NFC", form), hex(code)
            for kind in ("NFC", "NFD"):
                assert lookalike.canonical(unicodedata.normalize(kind, f"a{ch}b")) == form, hex(code)


def test_confusables_of_a_file(tmp_path):
    path = tmp_path / "table.txt"
    path.write_text("# comment\n0501 ;\t0064 ;\tMA\n1D0F ;\t006F ;\tMA # small capital o\n0031 ; 006C ; MA\n0441 0442 ; 0063 ; MA\n", encoding="utf-8")
    assert lookalike.read_confusables(str(path)) == {"ԁ": "d", "ᴏ": "o"}
    assert lookalike.canonical("ᴏ1") == "ᴏ1" and lookalike.canonical("ᴏ1", str(path)) == "o1"


def test_lookalike_classes(spark):
    rows = [(1, "cat"), (2, "cаt"), (3, "cat"), (4, "Cat"), (5, None), (6, " "), (None, "cat"), (2, "cаt")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"k": F.lit(1), "class_id": F.lit(2)})
    assert {tuple(r) for r in lookalike.lookalike_classes(df).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 1)}
    assert lookalike.lookalike_classes(df.limit(0)).count() == 0


def test_lookalike_pairs(spark):
    rows = [(1, "cat"), (2, "cаt"), (3, "cat"), (4, "Cat"), (5, None), (6, " "), (7, " "), (8, "​"), (2, "cаt"), (None, "cat"), (9, "x" * 100000), (10, "x" * 99999 + "х")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"k": F.lit(1), "f1": F.lit(2), "t": F.lit("t")})
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (9, 10)}
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    assert lookalike.normalize_documents(df).filter("doc_id = 2").first()["canonical_text"] == "cat"


PROSE = "The owner of Milo first noticed that the cat was not eating about three weeks before the visit to the clinic, and it slept more."
PAGE = [
    ("Home » Ask a vet » Kittens » Shop » Nutrition", True), ("Home / Ask a vet / Why Milo slept", True), ("We value your privacy. Choose which cookies you allow: necessary, marketing.", True),
    ("Written by Ann Lee for Cat Pages", True), ("Why Milo slept", False), (PROSE, False), ("", False), ("Signs seen in Milo, a Manx from Leeds", False), (PROSE, False),
    ("See also: Is ivy toxic? Lessons from Ann", True), ("Tuna cookies from Leeds are a treat that most cats accept, though a Manx may reject them.", False),
    ("| Milo | Home | 3.4 kg |", False), ("- Milo wet food, Leeds", False), (PROSE, False), ("Related pages", True), ("- Is ivy toxic? Lessons from Ann", True), ("How Luna of York lives with fleas", True),
    ("Tags: Milo, sleep, York", True), ("© 2021 Cat Pages. All rights reserved.", True), ("Back to top", True), ("Cat Pages, 12 Harbour Lane, Leeds", True),
]


def test_furniture():
    text = "\n".join(line for line, _ in PAGE)
    wanted = [n for n, (_, f) in enumerate(PAGE) if f]
    assert furniture.furniture(text, "Why Milo slept") == wanted
    assert furniture.furniture(text.upper(), "Why Milo slept") == wanted
    assert furniture.furniture("\r\n".join(f" {line} " for line, _ in PAGE), "Why Milo slept") == wanted
    assert furniture.furniture(None) == furniture.furniture("") == furniture.furniture(" \n ") == []
    for body in ("Milo (Leeds), fleas", "- Milo wet food, Leeds\n- Luna egg yolk, York\n- Coco goat milk, Bath", "404 Not Found: /x\nThe page you are looking for at /x does not exist.", PROSE):
        assert furniture.furniture(body, "Other") == []


def test_unlisted_sentences_outside_of_the_text():
    outside = ["This site keeps tiny data on your machine so that it works well for you.", "Get our letter each week and read what other owners of cats think.", "Nothing shown here may be sold or passed on to others by anyone.", "当サイトの文章は、だれも許可なく売ったり渡したりできません。"]
    page = ["Home » Ask a vet » Kittens » Shop", outside[0], "Log in", "Why Milo slept", PROSE, "Advertisement", outside[1], PROSE, "| Milo | Home | 3.4 kg |", "Tags: Milo, sleep, York", outside[1], outside[2], outside[3], "| Milo | Home |", "© 2021 Cat Pages"]
    assert furniture.furniture("\n".join(page), "Why Milo slept") == [0, 1, 2, 5, 9, 10, 11, 12, 14]
    page = ["Why Milo slept", PROSE, PROSE, "Related pages", "- Is ivy toxic? Lessons from Ann", outside[1]]
    assert furniture.furniture("\n".join(page), "Why Milo slept") == [3, 4, 5]
    # text that surges again below a list of pages, and text of which the larger part is above the heading, is kept
    assert furniture.furniture("\n".join([*page[:5], PROSE]), "Why Milo slept") == [3, 4]
    assert furniture.furniture("\n".join([PROSE, PROSE, "Why Milo slept", outside[1]]), "Why Milo slept") == []


def test_long_furniture():
    consent = "We value your privacy. " + "Together with the partners named in the list below, we keep data on your device and read it to show what may be of use to you. " * 2
    notice = "The texts of this site were written for readers at home and were looked through by its editors with care, " * 2 + "all rights reserved."
    menu = " | ".join(["Home", "Kittens", "Nutrition", "Ask a vet", "Toxic plants"] * 5)
    assert min(map(len, (consent, notice, menu))) > 200
    assert furniture.furniture("\n".join([menu, consent, PROSE, PROSE * 3, PROSE, notice]), "Other") == [0, 1, 5]


def test_surge_and_dive():
    text, row, other, found = furniture.TEXT, furniture.ROW, furniture.OTHER, furniture.surge_and_dive
    assert furniture.blocks([1, 2, 3, 4]) == [6, 9, 9, 9] and furniture.blocks([5]) == [5] and furniture.blocks([]) == []
    assert found([60, 50, 200, 300, 0, 150, 40, 90], [other, other, text, text, other, text, other, other]) == (2, 5)
    assert found([60, 20, 20, 20, 60], [other, row, row, row, other]) == (1, 3)
    assert found([60, 20, 60], [other, row, other]) == (0, -1) and found([], []) == (0, -1)


UNLISTED = [
    ("Etusivu – Kissat – Ruoka – Hoito", True), ("Käytämme pieniä tiedostoja laitteellasi", True), ("Kirjoittanut Anna Laine lehdelle", True),
    ("Milon päiväkirja", False), (PROSE, False), ("", False), (PROSE, False), ("| Milo | Home | 3.4 kg |", False), ("| Luna | Home | 3.9 kg |", False),
    ("Lue lisää", True), ("Ota yhteyttä", True), ("Kaikki oikeudet pidätetään Kissalehti", True), ("Sivun alkuun", True),
]


def test_a_page_in_an_unlisted_language_loses_menu_and_footer():
    assert furniture.furniture("\n".join(line for line, _ in UNLISTED), "Milon päiväkirja") == [n for n, (_, f) in enumerate(UNLISTED) if f]


def test_position_decides(monkeypatch):
    pages = ["\n".join(line for line, _ in page) for page in (PAGE, UNLISTED)]
    titles = ["Why Milo slept", "Milon päiväkirja"]
    with_it = list(map(furniture.furniture, pages, titles))
    monkeypatch.setattr(furniture, "surge_and_dive", lambda lengths, forms: (0, len(lengths) - 1))
    without = list(map(furniture.furniture, pages, titles))
    assert without[1] == [] and len(without[0]) <= len(with_it[0]) / 2


def test_furniture_operator(spark):
    text = "\n".join(line for line, _ in PAGE)
    df = spark.createDataFrame([("a", text, "Why Milo slept"), ("a", text, "Why Milo slept"), ("b", None, None), ("c", "", "x"), (None, text, "x")], "id string, content string, title string")
    df = df.withColumns({"k": F.lit(1), "lines": F.lit(2), "body": F.lit(3)})
    got = sorted(r["line_no"] for r in furniture.furniture_lines(df).collect())
    assert got == [n for n, (_, f) in enumerate(PAGE) if f]
    bodies = {r["id"]: r["content"] for r in furniture.main_body(df).collect() if r["id"]}
    assert bodies["b"] is None and bodies["c"] == "" and bodies["a"] == "\n".join(line for line, f in PAGE if not f)
    assert furniture.furniture_lines(df.limit(0)).count() == 0


RESIDUE = [
    "The {{ cat.name }} weighs a lot.", "Dear ${owner}, hello.", "<%= page.summary %>", "%%TITLE%% lives here.", "__MILO_BODY__", "#if($cat.x) $cat.x #end", "[INSERT NAME HERE]", "He says: [object Object]",
    "TODO: text about Milo goes here", "Lorem ipsum dolor.", "Milo was born in undefined and weighs NaN kg.", "Sample text.", "Your headline for Milo here.", "404 Not Found: /x",
    "Please enable JavaScript to view /x.", "503 Service Unavailable - down", "Access denied. Try again later.", "La página /x no existe.", "Seite /x nicht gefunden.", "Page introuvable : /x",
    "{% block a_b %}{% endblock %}", "Oops! We could not find “x”.", "Your session for /x has expired (1).", "Error establishing a database connection for /x",
    "[[PAGE_TITLE]]", "[[page.title]]", "@@summary@@", "<<NAME OF CAT>>", "*|FNAME|*", "%(name)s", "#{cat.name}", "Magna velit ullamco, reprehenderit in aliqua et laboris nisi.",
]
ORDINARY = [
    "Of the 404 cats that Ann studied, 54 were not found again.", "The register is a small JavaScript program, and it runs well.", "A towel is a good placeholder for the blanket.",
    "The feeder sends $62 bills and an undefined amount of kibble.", "The clinic was unavailable for 95 days.", "The error was made early, and access to water was denied for too long.", "We use cookies.",
    "The study had 65 cats [see table], and its text was reviewed.", "§__%§|<%=*%#{~{^", None, "", "written {a/a}, with both",
    "|l~{tho{{ht `t||as on`^ u~^nary 1r''|^}},", "{{''h`;}}", "Et in Arcadia ego est, sed labore magna.",
]


def test_residue(spark):
    rows = [(f"r{n}", "s", t) for n, t in enumerate(RESIDUE)] + [(f"o{n}", "s", t) for n, t in enumerate(ORDINARY)] + [("r0", "s", RESIDUE[0]), (None, "s", RESIDUE[0])]
    df = spark.createDataFrame(rows, "id string, source string, content string").withColumns({"k": F.lit(1), "message": F.lit(2), "h": F.lit(3)})
    got = sorted(r["id"] for r in residue.residue_documents(df).collect())
    assert got == sorted(f"r{n}" for n in range(len(RESIDUE)))
    assert residue.residue_documents(df.limit(0)).count() == 0
    assert residue.without_residue(df).filter("id like 'o%'").count() == len(ORDINARY)
    assert residue.residue_documents(df.withColumn("content", F.concat(F.lit(PROSE + "\n"), "content", F.lit("\nİ more")))).count() == len(RESIDUE)


#: One example for each branch of PLACEHOLDERS and PHRASES and for their alternatives.
BRANCHES = [
    "{{ name }}", "{% if %}", "${owner}", "#{x}", "@@x@@", "[[NAME]]", "[[a.b]]", "<<NAME>>", "*|NAME|*", "%(name)s", "<%= page %>", "%%TITLE%%", "__MILO_BODY__", "#if (x)", "#foreach(x)", "#set(x)", "$cat.name", "[object Object]", "[Insert name]", "[your name]", "[Enter x]", "[replace x]",
    "[add x]", "TODO: x", "tbd: x", "FIXME: x", "NaN kg", "Weight\tNaN", "nan %", "weighs undefined", "is null", "lorem ipsum", "dolor sit amet", "placeholder copy", "Sample text", "dummy text", "filler text",
    "replace this before publishing", "your headline goes here", "Your title here", "your text here", "your content here", "your logo here", "your tagline here", "click to edit", "click here to edit", "text about Milo goes here",
    "404 Not Found", "403 Forbidden", "401 Unauthorized", "410 Gone", "400 Bad Request", "502 Bad Gateway", "500 Internal Server Error", "503 Service Unavailable", "503 Service Temporarily Unavailable", "504 Gateway Timeout",
    "504 Gateway Time-out", "429 Too Many Requests", "HTTP error 404", "error code: 500", "Internal server error", "Page not found", "The page cannot be found.", "This page cannot be displayed", "the page you requested",
    "the URL you requested", "the document you are looking for", "the resource you’re looking for", "The requested URL /x was rejected", "Your support number is 1", "You don't have permission to access x",
    "you do not have permission to view x", "Access denied", "Verify that you are a human", "verify you are not a robot", "complete the captcha", "enable JavaScript", "turn on scripts", "activate scripts", "allow scripts",
    "switch on scripts", "needs scripts to run", "requires JavaScript.", "JavaScript is disabled", "Error establishing a database connection", "Fatal error: x", "Stack trace: #0", "Uncaught TypeError", "Something went wrong while x",
    "is down for maintenance", "Too many requests", "Your session x has expired", "We could not find “x”", "we couldn't find \"x\"", "Oops, we could not find x", "Oops, couldn’t find x", "Page introuvable", "Activez les scripts",
    "activez JavaScript", "La página x no existe", "la página no se encuentra", "página x no encontrada", "La página x no se encontró.", "Active los scripts", "active JavaScript", "Seite x nicht gefunden", "Bitte aktivieren Sie Skripte in Ihrem Browser.",
    "Aktivieren Sie bitte JavaScript", "страница x не найдена", "страницы x не существует", "Включите JavaScript", "включите скрипты", "ページは見つかりません", "ページが存在しません", "JavaScriptを有効にする",
]
WEAK = [
    "x not found", "unavailable", "under construction", "under maintenance", "Coming soon", "access denied", "access is blocked", "access was denied", "access has been denied", "forbidden", "went wrong", "try again later",
    "Oops", "a placeholder", "JavaScript", "a script", "please reload", "please refresh", "expired", "undefined",
]


def branches(pattern):
    """The alternatives of a pattern outside of all brackets."""
    parts, depth, n = [""], 0, 0
    while n < len(pattern):
        step = pattern[n : n + 2] if pattern[n] == "\\" else pattern[n : pattern.index("]", n + 2) + 1] if pattern[n] == "[" else pattern[n]
        depth += (step == "(") - (step == ")")
        if step == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += step
        n += len(step)
    return parts


def test_no_branch_lacks_a_hint():
    import re

    for pattern, examples, flags in ((residue.PLACEHOLDERS, BRANCHES, 0), (residue.PHRASES, BRANCHES, re.I), (residue.WEAK_PHRASES, WEAK, re.I)):
        for branch in branches(pattern):
            assert any(re.search(branch, e, flags) for e in examples), branch
    for example in BRANCHES + WEAK:
        for text in (example, example.replace(" ", "  "), example.replace(" ", " \t"), f"First line\r\n{example}\nlast İ line"):
            found = [m for line in residue.hinted_lines(text) for m in line]
            assert found == [text.split("\n")[1] if "\n" in text else text], text
    assert residue.hinted_lines("The banana and the nanny cost 5 cents, the pregnant cat is gone.") == []


def test_residue_of_every_branch(spark):
    blanks = [t.replace(" ", "  ") for t in ("404 Not Found", "Too many requests", "Page not found", "Access denied")]
    df = spark.createDataFrame([(f"r{n}", "s", t) for n, t in enumerate(BRANCHES + blanks)], "id string, source string, content string")
    got = {r["id"] for r in residue.residue_documents(df).collect()}
    assert [t for n, t in enumerate(BRANCHES + blanks) if f"r{n}" not in got] == []


def test_phrases_inside_of_a_line_count_if_they_recur(spark):
    line = "{} The page you are looking for at /x/{} does not exist, {} found. {}"
    rows = [(f"p{n}", f"s{n % 2}", line.format(PROSE, n, name, PROSE)) for n, name in enumerate(("Ann", "Bob", "Milo", "Luna", "Coco", "Leo"))]
    rows += [("once", "s0", f"{PROSE} The requested URL was rejected. {PROSE}"), ("alone", "s0", f"{PROSE}\nThe requested URL was rejected."), ("p0", "s1", rows[0][2])]
    df = spark.createDataFrame(rows, "id string, source string, content string")
    found = lambda **options: sorted(r["id"] for r in residue.residue_documents(df, **options).collect())
    assert found() == ["alone", *(f"p{n}" for n in range(6))]
    assert found(least_documents=7) == found(least_sources=3) == ["alone"]  # the groups decide
    assert residue.masked("404 Not Found: /a/b, Ann 12.5 on 2021-03-04 (a1b2c3d4)") == "404 <name> <name>: <path>, <name> 0 on <date> (<code>)"


def test_recurring_weak_messages(spark):
    rows = [(f"w{n}", f"s{n % 2}", f"Feeder {n} went wrong, id {n}{n}{n}{n}{n}{n}.") for n in range(6)] + [("x", "s0", "Once it went wrong.")]
    df = spark.createDataFrame(rows, "id string, source string, content string")
    assert sorted(r["id"] for r in residue.residue_documents(df).collect()) == [f"w{n}" for n in range(6)]
    assert residue.residue_documents(df, least_documents=7).count() == 0


def brute(rows, least):
    import re

    seen, places = {}, []
    for i, s, t in rows:
        if i is None or t is None:
            continue
        for n, line in enumerate(t.split("\n")):
            form = re.sub(r"[ \t　]+", " ", line.strip(" \t\r")).lower()
            if form.strip():
                seen.setdefault((s, form), set()).add(i)
                places.append((i, n, s, form))
    return {(i, n) for i, n, s, f in places if len(seen[s, f]) >= least}


def test_repeated_lines(spark):
    rng = random.Random(2)
    lines = ["Share this", " share  THIS\t", "", "Legal　notice", "legal notice", "one", "two", "Três", "\r", "three "]
    rows = [(rng.choice([f"d{n}", f"d{n}", None]), rng.choice(["a", "b", None]), rng.choice(["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), None, ""])) for n in range(60)]
    rows += rows[:7]
    df = spark.createDataFrame([(*r, f"2026-01-{n % 28 + 1:02d}") for n, r in enumerate(rows)], "id string, source string, content string, scraped_at string")
    df = df.withColumns({"scraped_at": F.col("scraped_at").cast("timestamp"), "h1": F.lit(1), "line": F.lit(2), "places": F.lit(3)})
    for least in (2, 5, 99):
        assert {(r["id"], r["line_no"]) for r in repeated.repeated_lines(df, least).collect()} == brute(rows, least)
    assert repeated.repeated_lines(df.limit(0)).count() == 0


def test_deltas(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id string, source string, content string")
    state = repeated.LineCounts(spark, 3)
    assert state.merge(mk([("a", "s", "x\ny"), ("b", "s", "x\nz")])).count() == 0
    assert state.merge(mk([("a", "s", "x\ny")])).count() == 0  # seen before
    crossed = state.merge(mk([("c", "s", "X \nq"), ("d", "t", "x")]))
    assert crossed.count() == 1
    assert {r["id"] for r in state.places(crossed).collect()} == {"a", "b", "c"}
    assert state.merge(mk([("e", "s", "x")])).count() == 0 and state.crossed().first()["n"] == 4
    cleaned = {r["id"]: r["content"] for r in state.clean(mk([("a", "s", "x\ny"), ("d", "t", "x"), ("n", "s", None)])).collect()}
    assert cleaned == {"a": "y", "d": "x", "n": None}


def test_a_document_that_comes_again_is_taken_back(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id string, source string, content string")
    state = repeated.LineCounts(spark, 3)
    assert state.merge(mk([(f"d{n}", "s", f"legal notice\nbody {n}") for n in range(3)])).count() == 1
    new = mk([("d0", "s", "fresh first line\n Legal  notice\nbody new")])
    assert state.merge(new).count() == 0
    assert [r["content"] for r in state.clean(new).collect()] == ["fresh first line\nbody new"]
    assert {(r["id"], r["line_no"]) for r in state.places().select("id", F.explode("places").alias("line_no")).collect()} == {("d0", 1), ("d1", 0), ("d2", 0)}
    # the line falls under the threshold again when one document loses it, and crosses it once more with another
    assert state.merge(mk([("d1", "s", None)])).count() == 0 and state.crossed().count() == 0
    assert state.clean(new).first()["content"] == new.first()["content"]
    assert state.merge(mk([("d9", "s", "LEGAL NOTICE")])).count() == 1 and state.crossed().first()["n"] == 3


def test_state_is_taken_up_again(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "id string, source string, content string")
    path = f"file://{tmp_path}/state"
    assert repeated.LineCounts(spark, 2, path).merge(mk([("a", "s", "x\ny")])).count() == 0
    again = repeated.LineCounts(spark, 2, path)
    assert again.batches == 1 and again.merge(mk([("a", "s", "x"), ("b", "s", "x")])).count() == 1
    last = repeated.LineCounts(spark, 2, path)
    assert last.batches == 2 and {r["id"] for r in last.places().collect()} == {"a", "b"}


def test_statistics_tell_kinds():
    held, truth = quality._examples(quality.HOLDOUT)
    seeds, kinds = quality._examples(quality.SEEDS)
    assert not {t for side in quality.HOLDOUT for t in side} & {t for side in quality.SEEDS for t in side}
    p = quality.BoostedTrees().fit(seeds[:, quality.SEEN], kinds).probability(held[:, quality.SEEN])
    assert ((p > 0.5) == truth.astype(bool)).mean() >= 0.8  # even from the few seeds alone
    assert quality.statistics("") == quality.statistics(" \n ") == [0.0] * len(quality.NAMES)
    assert len(quality.statistics("x")) == len(quality.NAMES)


def test_labels_come_of_what_the_trees_do_not_see():
    seen = {quality.NAMES[n] for n in quality.SEEN}
    assert not seen & {"prose_evidence", "junk_evidence", "lines"} and {"common_words", "word_length", "symbol_share", "closed_lines"} <= seen
    label = lambda text: quality.weak_label(quality.statistics(text))
    assert label("| Milo | Home |\n| Luna | Town |") == 1 and label(PROSE) == 0 and label("Milo (Leeds), fleas") == 0
    assert label("") == -1 and label("Milo went\nLuna stayed at home") == -1
    assert label("best cat best food best bed cheap best cat cheap best food") == 1


def test_trees_on_unseen_rows():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(float)
    model = quality.BoostedTrees(rounds=120).fit(x[:3000], y[:3000]).calibrate(x[3000:3500], y[3000:3500])
    assert ((model.probability(x[3500:]) > 0.5) == y[3500:].astype(bool)).mean() > 0.93


def test_not_prose(spark):
    prose, junk = quality.HOLDOUT
    rows = [(f"p{n}", t * 3, "T") for n, t in enumerate(prose)] + [(f"j{n}", t + "\n" + t, "T") for n, t in enumerate(junk)]
    rows += [("n", None, None), ("e", "", None), ("s", "Milo, home of Leeds: fleas", "T"), ("l", "Lorem ipsum dolor sit amet consectetur. " * 5, "T"), ("x", "404 Not Found: /a/b\nThe page you are looking for at /a/b does not exist.", "T"), (None, junk[0], "T"), ("j0", junk[0] + "\n" + junk[0], "T")]
    df = spark.createDataFrame(rows, "id string, content string, title string").withColumns({"k": F.lit(1), "stats": F.lit(2), "label": F.lit(3), "words": F.lit(4)})
    got = {r["id"] for r in quality.not_prose(df).collect()}
    assert {i for i in got if i[0] != "j"} == set() and len(got) == len(junk)
    assert quality.not_prose(df.limit(0)).count() == 0
    table = quality.quality_table(df.withColumn("metadata", F.struct(F.lit(5).alias("word_count"))))
    assert table.filter("id = 'p0'").first()["stored_word_count"] == 5


def test_the_trees_decide(spark, monkeypatch):
    class Sure:
        def __init__(self, p):
            self.p = p

        def probability(self, x):
            assert x.shape[1] == len(quality.SEEN)
            return x[:, 0] * 0 + self.p

    df = spark.createDataFrame([("k", PROSE, "T"), ("j", "| a | b |\n| c | d |", "T"), ("n", None, "T"), ("e", "", "T")], "id string, content string, title string")
    monkeypatch.setattr(quality, "fit", lambda *_: Sure(1.0))
    assert sorted(r["id"] for r in quality.not_prose(df).collect()) == ["j", "k"]
    monkeypatch.setattr(quality, "fit", lambda *_: Sure(0.0))
    assert quality.not_prose(df).count() == 0


def test_calibration_settles():
    import numpy as np

    x, y = np.array([-9.0] * 8 + [-2.0] * 8 + [6.0] * 8 + [9.0] * 8)[:, None], np.array([0.0] * 16 + [1.0] * 16)
    model = quality.BoostedTrees()
    model.score = lambda rows: rows[:, 0]
    for shift in range(-12, 13, 3):
        model.calibrate(x * 1.5 + shift / 8, y)
        assert ((model.probability(x * 1.5 + shift / 8) > 0.5) == y.astype(bool)).all()
