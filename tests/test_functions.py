import re

from pyspark.sql import functions as F

from codeloom.functions import identifiers as ident
from codeloom.functions import like, paths, text


def one(spark, column):
    return spark.sql("SELECT 1").select(column.alias("v")).first()["v"]


def test_identifier_tokens(spark):
    cases = {
        "rotateRefreshToken": ["rotate", "refresh", "token"],
        "Payment_retry_coord": ["payment", "retry", "coord"],
        "HTTPServer2Handler-v1": ["http", "server", "2", "handler", "v", "1"],
        "": [], "---": [], "漢字": ["漢字"], "été": ["t"],
    }
    for word, expected in cases.items():
        assert one(spark, ident.identifier_tokens(F.lit(word))) == expected, word


def test_symbol_key(spark):
    key = ident.symbol_key(F.lit("python"), F.lit("src\\utils\\helper.py"), F.lit("MyClass"), F.lit("do_work"),
                           F.lit("x: int, y: int"), F.lit(42))
    assert one(spark, key) == "python://src/utils/helper.py::MyClass#do_work(x: int, y: int)@L42"
    assert one(spark, ident.symbol_key(F.lit("java"), F.lit("/com/example/Test.java"), None, F.lit("main"))) == "java://com/example/Test.java#main"


def test_symbol_query(spark):
    parsed = one(spark, ident.parse_symbol_query(F.lit("python://src/app.py::Server#start(port)")))
    assert tuple(parsed)[:3] == ("python", "src/app.py::Server", "start")
    parsed = one(spark, ident.parse_symbol_query(F.lit("com.acme.AuthService.validateToken")))
    assert tuple(parsed)[:3] == (None, "com.acme.AuthService", "validateToken")
    assert tuple(one(spark, ident.parse_symbol_query(F.lit("rotate(user_id)"))))[:3] == (None, None, "rotate")
    assert one(spark, ident.normalize_lookup(F.lit("Foo.bar(String, int)"))) == "Foo.bar"
    assert one(spark, ident.normalize_lookup(F.lit("x.py#f@L12 "))) == "x.py#f"


def test_like_matches_sql_like(spark):
    def sql_like(hay, needle):
        pattern = "".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in needle)
        return re.search(pattern, hay, re.I | re.S) is not None
    pairs = [("src/Retry_Coord.py", "retry_coord"), ("retryXcoord", "retry_coord"), ("a\\b", "\\b"), ("abc", "a%c"), ("abc", "d"), ("x", "")]
    rows = spark.createDataFrame(pairs, "h string, n string").select("h", "n", like.contains_like("h", "n").alias("v")).collect()
    assert [r["v"] for r in rows] == [sql_like(r["h"], r["n"]) for r in rows]


def test_paths(spark):
    cases = [("src/latest.py", True), ("a/UserTest.java", True), ("spec/x.py", False), ("a/FooSpec.kt", True), ("src/main.py", False), ("tests/a.py", True)]
    frame = spark.createDataFrame(cases, "p string, e boolean")
    assert all(r["v"] == r["e"] for r in frame.select("e", paths.is_test_path("p").alias("v")).collect())
    ignored = [("build/x.py", True), ("builder/x.py", False), ("a/__pycache__/x.py", False), ("x.pyc", True), ("tmp/a.py", True), ("deep/tmp/a.py", True), ("a.log", True)]
    frame = spark.createDataFrame(ignored, "p string, e boolean")
    got = {r["p"]: r["v"] for r in frame.select("p", paths.is_ignored("p", gitignore=("tmp/", "*.log")).alias("v")).collect()}
    assert got == dict(ignored)
    assert one(spark, paths.is_noise_path(F.lit("Tests/a.py"))) and not one(spark, paths.is_noise_path(F.lit("src/testing.py")))
    assert one(spark, paths.file_stem(F.lit("a/b.tar.gz"))) == "b.tar" and one(spark, paths.file_stem(F.lit("a/.env"))) == ".env"
    assert one(spark, paths.display_language(F.lit("a.markdown"))) == "text"


def test_split_lines_is_python_splitlines(spark):
    samples = ["", "\n", "a", "a\n", "a\n\nb", "a\r\nb\rc", "x\x0by\x0cz\x1cq\u2028r\x85s\n\n"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text.split_lines("t").alias("v")).collect()
    assert [r["v"] for r in rows] == [r["t"].splitlines() for r in rows]


def test_budget(spark):
    assert one(spark, text.budget_add(F.lit("Hello "), 0, 20)) == "Hello "
    cut = one(spark, text.budget_add(F.lit("World! More extra text"), 6, 20))
    assert cut.startswith("World! More ex\n...") and "budget limit" in cut
    lines = F.array(*(F.lit(f"Line {i}") for i in range(1, 6)))
    assert "Showing 2 of 5 rows" in one(spark, text.truncate_lines(lines, 15, "rows"))
    assert one(spark, text.truncate_lines(F.array(F.lit("A"), F.lit("B")), 50)) == "A\nB"
    assert one(spark, text.numbered_line(F.lit(12345), F.lit("x"))) == "12345 | x"


def test_fold(spark):
    assert one(spark, text.search_tokens(F.lit("Éléphant_ÜBER.naïve2 日本"))) == ["elephant", "uber", "naive2", "日本"]
