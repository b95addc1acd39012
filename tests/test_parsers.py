import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import build, pysyntax, sections, syntax

JAVA = b'''package com.demo;

/** Keeps accounts. */
@Anno(name = "x", tags = {"a", "b"})
public class Accounts<T extends Row> extends Base implements Store, Gen<T>, a.B {
    private String name = make();
    int[] sizes = {1, 2};
    static { prepare(); }
    // finds
    // an account
    @Override
    public <R> Map<String, R> find(String id, int[] xs) throws Exception {
        if (id == null) { check(id, "}"); }
        Runnable r = new Runnable() { public void run() { this.name.trim().length(); } };
        return new Account(id);
    }
    public <T> Accounts(T t) { super(t); }
    protected abstract void check(String id);
    enum Status { ACTIVE("a"), DONE; void act() { go(); } }
    record Point(int x) implements Q {}
}
interface Finder extends Other { Account get(String id); default void all() { list(); } }
'''
KOTLIN = '''package com.demo
interface Repo {
    fun byId(id: String): User?
}
data class User(val id: String) : Entity()
class Service(private val repo: Repo) : Base<Int>(1), Api, com.z.Zed, Lazy by impl {
    /**
     * Reads – with a dash.
     */
    @Deprecated("x")
    fun read(id: String): User {
        val user = repo?.byId(id) ?: error("no }")
        listOf(1).map { it + 1 }.forEach { show(it) }
        return user
    }
    companion object {
        fun of(): Service = Service(
            Repo())
        val x = 3
    }
    constructor(a: Int) : this() { boot() }
    private fun <T> String.tag(user: T) = print(user)
}
'''.encode()
SWIFT = b'''protocol Sender { func send(_ x: Int) -> Bool }
extension Wallet: Sender {
    func send(_ x: Int) -> Bool { return true }
}
enum Kind { case one(Int)
  indirect case two }
class Screen<T>: View, Themed {
    override init?(x: Int) { super.init() }
    static func make() -> Screen { guard x.ready else { return stop() }; return items.map { build($0) } }
}
'''
PYTHON = '''import os

@deco
class A(base.B, C):
    def f(self, x: "int:1" = 3) -> int: return g(x)

    async def h(self,
                y):  # note: here
        """Doc é."""
        é = self.a.b(y)()
        return [i() for i in é]
'''.encode()
BAD = b"def broken(:\n"
MARKDOWN = b'''intro is dropped
# A

text
## B
```
# no
```
#### D
### C
# E
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("A.java", JAVA), ("s.kt", KOTLIN), ("w.swift", SWIFT), ("p.py", PYTHON), ("bad.py", BAD), ("r.md", MARKDOWN),
            ("plain.md", b"no headings\n"), ("empty.md", b"\n \n"), ("open.java", b"class X { void f() { g(\n")]
    return spark.createDataFrame(rows, "path string, content binary").withColumn("language", paths.language_of("path"))


@pytest.fixture(scope="module")
def brace(files):
    symbols, references, errors = syntax.parse(files)
    return symbols.collect(), syntax.enclose_references(references, symbols).collect(), {r["path"]: r[1] for r in errors.collect()}


def names(rows, path):
    return {(r["kind"], r["qualified_name"]) for r in rows if r["path"] == path}


def test_java(brace):
    symbols, references, _ = brace
    assert names(symbols, "A.java") == {
        ("class", "com.demo.Accounts"), ("method", "Accounts.find"), ("method", "find.run"), ("method", "Accounts.Accounts"),
        ("method", "Accounts.check"), ("class", "Accounts.Status"), ("method", "Status.act"), ("record", "Accounts.Point"),
        ("interface", "com.demo.Finder"), ("method", "Finder.get"), ("method", "Finder.all")}
    found = {r["qualified_name"]: r for r in symbols if r["path"] == "A.java"}
    assert found["Accounts.find"]["docstring"] == "finds\nan account"
    assert found["com.demo.Accounts"]["docstring"] == "Keeps accounts."
    assert found["Accounts.find"]["symbol_key"].endswith("::Accounts#find(String id, int[] xs)@L11")
    assert JAVA[found["Accounts.find"]["body_start_byte"]:found["Accounts.find"]["body_end_byte"]].endswith(b"(id);\n    }")
    assert found["Accounts.check"]["signature"] == "protected abstract void check(String id)"
    refs = {(r["role"], r["spelling"], r["receiver"]) for r in references if r["path"] == "A.java"}
    assert refs == {
        ("extends", "Base", None), ("implements", "Store", None), ("implements", "Q", None), ("call", "make", None),
        ("call", "prepare", None), ("call", "check", None), ("instantiation", "Runnable", None), ("instantiation", "Account", None),
        ("call", "trim", "this.name"), ("call", "length", "this.name.trim()"), ("call", "go", None), ("call", "list", None)}
    inner = next(r for r in references if r["spelling"] == "trim")
    assert "#run()" in inner["enclosing_key"]


def test_kotlin(brace):
    symbols, references, _ = brace
    assert names(symbols, "s.kt") == {
        ("class", "com.demo.Repo"), ("method", "Repo.byId"), ("class", "com.demo.User"), ("class", "com.demo.Service"),
        ("method", "Service.read"), ("class", "Service.Companion"), ("method", "Companion.of"), ("method", "Service.constructor"),
        ("method", "Service.tag")}
    read = next(r for r in symbols if r["name"] == "read")
    assert read["docstring"] == "Reads – with a dash." and KOTLIN[read["start_byte"]:].startswith(b"@Deprecated")
    refs = {(r["role"], r["spelling"], r["receiver"]) for r in references if r["path"] == "s.kt"}
    assert refs == {
        ("extends", "Entity", None), ("extends", "Base", None), ("implements", "Api", None), ("implements", "Zed", None),
        ("call", "byId", "repo"), ("call", "error", None), ("call", "listOf", None), ("call", "map", "listOf(1)"),
        ("call", "forEach", "listOf(1).map { it + 1 }"), ("call", "show", None), ("call", "Service", None), ("call", "Repo", None),
        ("call", "boot", None), ("call", "print", None)}


def test_swift(brace):
    symbols, references, _ = brace
    assert names(symbols, "w.swift") == {
        ("interface", "Sender"), ("method", "Sender.send"), ("function", "send"), ("class", "Kind"), ("class", "Screen"),
        ("method", "Screen.init"), ("method", "Screen.make")}
    refs = {(r["role"], r["spelling"], r["receiver"]) for r in references if r["path"] == "w.swift"}
    assert {("implements", "Sender", None), ("implements", "View", None), ("implements", "Themed", None), ("call", "stop", None),
            ("call", "map", "items"), ("call", "build", None)} <= refs
    assert not {"one", "ready"} & {s for _, s, _ in refs}


def test_errors(brace):
    assert brace[2] == {"A.java": 0, "s.kt": 0, "w.swift": 0, "open.java": 3}


def test_python(files):
    symbols, references, errors = (f.collect() for f in pysyntax.parse(files))
    found = {r["qualified_name"]: r for r in symbols}
    assert set(found) == {"A", "A.f", "A.h"}
    assert found["A"]["signature"] == "class A(B, C)" and found["A"]["start_line"] == 4
    assert found["A.f"]["signature"] == 'def f(self, x: "int:1" = 3) -> int'
    assert found["A.h"]["signature"] == "async def h(self,\n                y)"
    assert PYTHON[found["A.h"]["body_start_byte"]:].decode().startswith("é = self")
    refs = {(r["role"], r["spelling"], r["receiver"]) for r in references}
    assert refs == {("extends", "B", None), ("extends", "C", None), ("call", "g", None), ("call", "b", "a"), ("call", "i", None)}
    call = next(r for r in references if r["spelling"] == "b")
    assert PYTHON[call["start_byte"]:call["end_byte"]] == b"self.a.b(y)"
    assert {r["path"]: r["parse_error_count"] for r in errors} == {"p.py": 0, "bad.py": 1}


def test_markdown(files):
    rows = sorted(sections.parse(files).collect(), key=lambda r: (r["path"], r["start_line"]))
    got = [(r["heading"], r["heading_level"], r["heading_path"], r["start_line"], r["end_line"], r["content"]) for r in rows]
    assert got == [
        ("plain.md", 1, ["plain.md"], 1, 1, "no headings"),
        ("A", 1, ["A"], 2, 4, "text"), ("B", 2, ["A", "B"], 5, 8, "```\n# no\n```"), ("D", 4, ["A", "B", "D"], 9, 9, ""),
        ("C", 3, ["A", "B", "C"], 10, 10, ""), ("E", 1, ["E"], 11, 11, "")]
    for r in rows:
        if r["path"] == "r.md":
            assert MARKDOWN[r["start_byte"]:].startswith(b"#" * r["heading_level"] + b" " + r["heading"].encode())


def test_index_tables(files):
    full = build.with_hash(files.withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("mtime_ns", F.lit(1).cast("long")))
    tables = build.written(build.build_index(full))
    errors = {r["path"]: r["parse_error_count"] for r in tables["files"].collect()}
    assert errors["bad.py"] == 1 and errors["r.md"] == 0 and len(errors) == 9
    symbols = {r["sym_id"]: r for r in tables["symbols"].collect()}
    parents = {r["qualified_name"]: symbols[r["parent_id"]]["qualified_name"] for r in symbols.values() if r["parent_id"]}
    assert parents["Accounts.find"] == "com.demo.Accounts" and parents["A.f"] == "A"
    assert all(o["enclosing_id"] in symbols for o in tables["occurrences"].collect() if o["enclosing_id"])
    docs = {r["heading"]: r for r in tables["docs"].collect()}
    assert docs["D"]["parent_id"] == docs["B"]["doc_id"] and docs["A"]["parent_id"] is None


def test_flat_backend(files):
    symbols = syntax.parse(files, "flat")[0].collect()
    assert names(symbols, "s.kt") == {
        ("interface", "com.demo.Repo"), ("method", "Repo.byId"), ("class", "com.demo.User"), ("class", "com.demo.Service"),
        ("method", "Service.read"), ("companion object", "com.demo.Companion"), ("method", "Companion.of"), ("method", "String.tag")}
    java = names(symbols, "A.java")
    assert {("class", "com.demo.Accounts"), ("enum", "com.demo.Status"), ("record", "com.demo.Point"), ("interface", "com.demo.Finder"),
            ("method", "Finder.find"), ("method", "Finder.all")} <= java
    assert names(symbols, "w.swift") >= {("class", "Screen"), ("method", "Screen.make")}
