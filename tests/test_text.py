import random
import re
import unicodedata

from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions import items as I
from fitloom.functions import numbers as N
from fitloom.functions import text as X
from fitloom.operators import extract

TEXTS = [
    None, "", "  \t ", "plain text",
    "Need python3, NODEJS and k8s;\trest  api\n\n\n\nci-cd",
    "<p>Deep <b>learning</b></p> & more",
    "see https://a.example/x?y=1 or www.b.example, mail me@c.example now",
    "Kế toán và Học Máy", "restful API and C++ C# .NET", "a²b x​y ‿  z  ",
    "ſql PYTHON İso ISO kế TOÁN", "power bi Power BI js.js node.js", "한각 é",
]


def test_nfc_and_slug(column):
    assert column(X.nfc, TEXTS) == [None if t is None else unicodedata.normalize("NFC", t) for t in TEXTS]
    assert column(X.slug, ["công_nghệ Thông tin/số", "__Đà Lạt__", "a--b"]) == [
        "cong_nghe_thong_tin_so", "đa_lat", "a_b"]


def test_cleaning_steps(column):
    html = ["a<br/>b<x\ny>c<>", "1 < 2", "<p>x</p> a < b", "", "<é>ü > <", ">"]
    assert column(X.strip_html, html) == [re.sub(r"<[^>]+>", " ", h) for h in html]
    assert column(X.strip_html, ["<" * 300_000]) == ["<" * 300_000]
    assert column(X.strip_urls, ["x http://a.b/c d@e.fg, h@i j"]) == ["x     h@i j"]
    assert column(X.strip_special, ["a&b|c+#/.-,;:!?()[]_é²"]) == ["a b c+#/.-,;:!?()[]_é²"]
    assert column(X.normalize_ws, [" a\t\tb\r\n\n\n\nc   d "]) == ["a b \n\nc d"]


def test_aliases_follow_the_ordered_rules(column):
    def brute(text):
        for pattern, replacement in rules.ALIAS_RULES:
            text = re.sub(pattern, lambda m, r=replacement: r, text, flags=re.IGNORECASE)
        return text
    texts = [t for t in TEXTS if t is not None]
    assert column(X.rewrite_aliases, texts) == [brute(t) for t in texts]
    assert column(X.rewrite_aliases, ["node.js"]) == ["node.JavaScript"]


def test_clean_text_handles_blank(column):
    out = column(X.clean_text, TEXTS)
    assert out[:4] == ["", "", "", "plain text"]
    assert out[4] == "Need Python, Node.js and Kubernetes; REST API\n\nCI/CD"


def test_lists(column):
    cases = {"['a', ' b ']": ["a", "b"], '["it\'s", \'x\',]': ["it's", "x"], "[1, True, 2.50]": ["1", "True", "2.5"],
             "['it\\'s', '']": ["it's"], "plain": ["plain"], "('a','b')": ["('a','b')"], "[broken": ["[broken"],
             "['a' 'b']": ["ab"], "[]": [], " ": [], "[['x']]": ["['x']"], "['a'] tail": ["['a'] tail"]}
    assert column(X.parse_list, list(cases)) == list(cases.values())
    assert column(X.parse_list, [None]) == [[]]
    assert column(X.clean_list, ["['k8s', '&&', ' rest api']"]) == [["Kubernetes", "REST API"]]


def test_extraction_equals_plain_search(column):
    def brute(text, stop):
        found, seen = [], set()
        for pattern in rules.ITEM_PATTERNS:
            m = re.search(pattern, text, re.IGNORECASE)
            item = m and m.group(0).strip()
            if item and item.lower() not in seen and item.lower() not in stop:
                seen.add(item.lower())
                found.append(item)
        return found
    texts = [unicodedata.normalize("NFC", t) for t in TEXTS if t] + [
        "SAP ERP, Oracle ERP; KOTLIN kotlin sketchup c&b HTML5 html", "nosql SQL server sql"]
    assert column(extract.extract_items, texts) == [brute(t, set(rules.STOP_ITEMS)) for t in texts]
    stop = ["sql"]
    got = column(lambda c: extract.extract_items(c, stop_items=stop), texts)
    assert got == [brute(t, set(stop)) for t in texts]


def test_segments(column):
    text = ("Intro that is long enough to keep\n- first duty is long enough\n- short\n2) second duty, long enough\n\n"
            "Responsibilities:\n- FIRST duty is long enough")
    expected = ["Intro that is long enough to keep", "first duty is long enough", "second duty, long enough"]
    assert column(lambda c: extract.segments(c, F.lit("")), [text]) == [expected]
    many = "\n".join(f"- duty number {i} described here" for i in range(40))
    for limit, n in ((None, 40), (20, 20)):
        assert len(column(lambda c: extract.segments(c, F.lit(""), limit), [many])[0]) == n  # noqa: B023
    same = "\n- " + "x" * 90 + " one\n- " + "x" * 90 + " two"
    assert [len(column(lambda c: extract.segments(c, F.lit(""), None, k), [same])[0]) for k in (None, 80)] == [2, 1]  # noqa: B023
    assert column(lambda c: extract.segments(c, F.lit("a fallback text of some length")), [" "]) == [
        ["a fallback text of some length"]]


def test_merge_items(spark):
    df = spark.createDataFrame([(["Go", " sql "], ["x", "Teamwork", "SQL"], ["go", "Rust"])],
                               "a array<string>, b array<string>, c array<string>")
    out = df.select(extract.merge_items(F.col("a"), F.col("b"), F.col("c")).alias("m")).first().m
    assert out == ["Go", "sql", "Rust"]


def test_canonical_items(column):
    cases = {"REST API APIs": "REST API", "Node.JavaScript": "Node.js", "erP": "ERP", "Kế  toán": "Kế toán",
             "a b b B": "a b", " reactjs ": "React.js", "học máy": "Machine Learning", "x": "x", "": ""}
    out = column(I.canonicalize, list(cases))
    assert out == list(cases.values())
    assert column(I.canonicalize, out) == out


def test_rounding_is_that_of_python(column):
    random.seed(1)
    values = [random.random() for _ in range(500)] + [round(random.random(), 5) for _ in range(3000)]
    values += [0.8 * round(random.random(), 6) + 0.2 * round(random.random(), 6) for _ in range(3000)]
    values += [0.5, 1.5, 2.5, -0.5, 0.12345, -0.12345, 0.0, 123456.78905]
    for digits in (0, 1, 4, 6):
        got = column(lambda c: N.round_half_even(c, digits), values, "double")
        assert got == [round(v, digits) for v in values]


def test_names_and_bands(column):
    assert column(X.display_name, ["công_nghệ thông_tin", "_", "éa"]) == ["Công nghệ thông tin", "_", "Éa"]
    assert column(X.group_key, [" Data Science "]) == ["data_science"]
    assert column(N.score_bucket, [0.0, 0.2, 0.59, 0.99, 1.0], "double") == [0, 1, 2, 4, 4]
    good, partial, low = rules.VERDICT_LABELS
    assert column(lambda c: I.verdict(I.score_percent(c)), [0.7, 0.69949, 0.4, 0.1, -3.0, 9.0], "double") == [
        good, partial, partial, low, low, good]
    assert column(I.item_tier, [0.4, 0.15, 0.1], "double") == ["core", "important", "supporting"]


def test_positions(spark):
    taxonomy = [("it", "web", "Web", [r"front[\s-]?end", r"\bweb\b"]), ("it", "any", "Any", ["dev"]),
                ("hr", "any", "Any", ["dev"])]
    rows = [("it", "Frontend dev"), ("it", "DEV ops"), ("it", "cook"), ("hr", "web"), ("it", None)]
    df = spark.createDataFrame(rows, "p string, t string")
    out = [r.s for r in df.select(I.assign_position(F.col("t"), F.col("p"), taxonomy).alias("s")).collect()]
    assert out == ["web", "any", None, None, None]


def test_required_literal():
    cases = {r"a|b": "", r"ab?c": "a", r"ab+cd": "ab", r"x{2}yz": "yz", r"(?:foo|bar)baz\.js": "baz.js", r"[]a-z]qq": "qq",
             r"\bgo\b": "go", r"c\+\+": "c++", r"(?<![a-z])r(?![a-z])": "r", r"a*?bc": "bc", r"\d\s": "", r"a(b(c|[)])d)e": "a"}
    assert {p: X.required_literal(p) for p in cases} == cases
    assert sum(len(X.required_literal(p)) > 1 for p in rules.ITEM_PATTERNS) > 0.8 * len(rules.ITEM_PATTERNS)


def test_names_are_looked_up_by_a_set(spark):
    """A map is searched entry by entry; only a name that the set holds goes to it, and only equal last tokens to a list."""
    df = spark.createDataFrame([("sql",), ("REST API APIs",), ("a  b",), ("x\ny",), ("",), (" ",), ("b b b",), ("b a b",), (None,)], "v string")
    out = df.select(I.canonicalize(F.col("v")).alias("c"))
    assert " INSET " in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.c for r in out.collect()] == ["SQL", "REST API", "a b", "x y", "", "", "b", "b a b", None]
