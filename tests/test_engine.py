import io
import json
import os
import shutil

import pytest

from codeloom import __main__ as cli
from codeloom.config import Config
from codeloom.engine import CodeIndex
from codeloom.errors import PathOutsideRoot
from codeloom.session_log import SessionLog
from codeloom.sources import guard
from codeloom.streaming import watch
from codeloom.tools import TOOLS, Rpc


def test_index_counts(index):
    assert index.first_counts["total_files"] == index.first_counts["indexed_files"] == 7
    status = index.index_status()
    assert status["state"] == "ready" and status["files"] == 7
    assert status["languages"] == {"java": 1, "kotlin": 1, "markdown": 1, "python": 3, "swift": 1}


def test_second_index_skips_all(index):
    again = index.index()
    assert (again["indexed_files"], again["skipped_files"]) == (0, 7)


def test_flow_finds_both_sides(index):
    flow = index.explore_flow("Invoicer.issue")
    assert {c["name"] for c in flow["callees"]} == {"read_total", "check_total"}
    assert "checkout" in {c["name"] for c in flow["callers"]}
    assert "```python" in flow["flow"] and flow["docs"]


def test_impact(index):
    result = index.analyze_impact("Invoicer.issue", depth=2)
    assert "checkout" in {c["name"] for c in result["upstream_callers"]}
    assert result["summary"]["affected_test_files"] == 1
    assert "tests/test_billing.py" in result["report"]


def test_unknown_and_ambiguous(index):
    assert index.analyze_impact("nothing_like_this")["status"] == "not_found"
    answer = index.get_symbol_code("__init__")
    assert answer["status"] == "ambiguous" and len(answer["candidates"]) == 2
    assert index.get_symbol_code("__init__", class_context="Meter")["status"] == "success"


def test_search(index):
    found = index.search_semantic("login token")
    assert any("renewLoginToken" in str(r.get("name")) for r in found["results"])
    assert index.search_semantic("zzz_absent_qqq", context_symbol="Login")["count"] == 0
    assert all(r["kind"] == "class" for r in index.search_semantic("Login", kinds=["class"])["results"])
    near = index.search_semantic("issue", context_symbol="Invoicer")
    assert near["results"][0]["match"]["proximity_depth"] == 0
    assert any(r["kind"] == "file" for r in index.search_semantic("uide")["results"])


def test_usages(index):
    found = index.find_usages("issue")
    assert any(g["file"] == "app/Desk.kt" for g in found["usages_by_file"])
    assert "hidden" in found["note"]
    usage = found["usages_by_file"][0]["usages"][0]
    assert "> " in usage["snippet"]
    strict = index.find_usages("issue", include_probable=False)
    assert strict["total_found"] == strict["exact_count"]


def test_implementations(index):
    below = index.find_implementations("Meter")
    assert [r["name"] for r in below["direct_implementers"]] == ["Invoicer"]


def test_context(index):
    content = index.get_context("Billing")["content"]
    assert "[Documentation]" in content and "Invoicer" in content


def test_skeleton_and_back_reference(spark, repo):
    engine = CodeIndex(spark, repo)
    plain = engine.get_skeleton("src/billing.py")["skeleton"]
    assert "implementation omitted" in plain and "Issues an invoice." in plain and "read_total(key)" not in plain
    code = engine.get_symbol_code("Invoicer.issue")
    assert not code["is_deduplicated"] and "check_total" in code["code"]
    assert not engine.get_symbol_code("Invoicer.issue")["is_deduplicated"]   # same turn
    engine.session.next_turn()
    again = engine.get_symbol_code("Invoicer.issue")
    assert again["is_deduplicated"] and "Turn 1" in again["code"]
    assert "Turn 1" in engine.get_skeleton("src/billing.py")["skeleton"]
    assert not engine.get_symbol_code("Invoicer.issue", force=True)["is_deduplicated"]
    engine.session.next_turn()
    assert "Turn 2" in engine.get_symbol_code("Invoicer.issue")["code"]
    assert "# Guide" in engine.get_skeleton("docs/guide.md")["skeleton"]


def test_reading(index):
    assert index.read_lines("src/billing.py", 1, 2)["content"].startswith("   1 | ")
    assert index.read_lines("src/billing.py", 900, 950)["content"] == ""
    assert "error" in index.read_lines("absent.py", 1, 2)
    view = index.read_file_structural("src/billing.py")
    assert "app/Desk.kt" in view["upstream_dependents"] and view["total_lines"] == 27
    assert "Structural Context" in view["content"]
    tree = index.get_file_tree("src")
    assert {f["path"] for f in tree["files"]} == {"src/billing.py", "src/__init__.py"}


def test_guard(repo):
    with pytest.raises(PathOutsideRoot):
        guard.resolve(repo, "../elsewhere")
    with pytest.raises(PathOutsideRoot):
        guard.resolve(repo, "keys/server.pem")
    assert guard.resolve(repo, ".env", allow_sensitive=True).name == ".env"


def test_rpc(index):
    rpc = Rpc(index)
    assert rpc.handle({"id": 1, "method": "initialize"})["result"]["serverInfo"]["name"] == "codeloom"
    assert rpc.handle({"method": "notifications/initialized"}) is None
    assert len(rpc.handle({"id": 2, "method": "tools/list"})["result"]["tools"]) == len(TOOLS) == 12
    assert rpc.handle({"id": 3, "method": "absent"})["error"]["code"] == -32601
    assert rpc.handle({"id": 4, "method": "tools/call", "params": {"name": "absent"}})["error"]["code"] == -32601
    bad = rpc.handle({"id": 5, "method": "tools/call", "params": {"name": "read_lines", "arguments": {"file_path": "../x", "start": 1, "end": 2}}})
    assert bad["result"]["isError"]
    out = io.StringIO()
    rpc.run(["not json", json.dumps({"jsonrpc": "2.0", "id": 6, "method": "ping"})], out)
    assert json.loads(out.getvalue())["result"] == {}


def test_config(tmp_path):
    assert Config.load(tmp_path).index.parse_workers == 4
    (tmp_path / ".codeloom.toml").write_text("[repository]\nmax_file_bytes = 10\n[search]\ndefault_limit = 3\n")
    loaded = Config.load(tmp_path)
    assert (loaded.repository.max_file_bytes, loaded.search.default_limit) == (10, 3)
    (tmp_path / ".codeloom.toml").write_text("broken [[")
    assert Config.load(tmp_path) == Config()
    (tmp_path / ".codeloom.toml").write_text(Config().to_toml())
    assert Config.load(tmp_path) == Config()


def test_changes_follow_the_tree(spark, repo, tmp_path):
    root = tmp_path / "copy"
    shutil.copytree(repo, root, ignore=shutil.ignore_patterns(".codeloom"))
    engine = CodeIndex(spark, root, session=SessionLog())
    engine.index()
    (root / "app/Desk.kt").unlink()
    (root / "src/billing.py").write_text("def lone():\n    return 1\n")
    counts = engine.index()
    assert counts["indexed_files"] == 1
    assert {r["path"] for r in engine.files.collect()} == {
        "src/billing.py", "src/__init__.py", "auth/Login.java", "ios/Login.swift", "docs/guide.md", "tests/test_billing.py"}
    assert {r["name"] for r in engine.symbols.where("path = 'src/billing.py'").collect()} == {"lone"}
    assert engine.find_usages("issue")["total_found"] == 0   # the only other usage is a test
    (root / "src/new.py").write_text("def fresh():\n    return lone()\n")
    query = watch.watch_tree(spark, engine.store, root, engine.config, [], str(tmp_path / "state"), {"availableNow": True})
    query.awaitTermination()
    engine.refresh()
    assert "fresh" in {r["name"] for r in engine.symbols.collect()}
    (root / "src/new.py").unlink()
    engine.sync_path("src/new.py")
    assert "fresh" not in {r["name"] for r in engine.symbols.collect()}


def test_cli(spark, repo, tmp_path):
    root = tmp_path / "copy"
    shutil.copytree(repo, root, ignore=shutil.ignore_patterns(".codeloom"))
    parse = cli.arguments().parse_args

    def run(*words):
        out = io.StringIO()
        return cli.run(parse([*words, "--repo", str(root)]), spark, out), out.getvalue()
    assert run("status")[0] == 1
    assert run("init")[0] == 0 and (root / ".codeloom.toml").exists()
    assert '"files": 7' in run("status")[1]
    assert "issue" in run("symbol", "Invoicer.issue")[1]
    assert run("symbol", "absent_symbol")[0] == 1
    assert "Impact" in run("impact", "Invoicer.issue", "--no-tests")[1]
    assert run("clean")[0] == 0 and not (root / ".codeloom").exists()


def test_nothing_is_lost_between_tree_and_answers(spark, repo, tmp_path):
    """A file that is too large is listed, one with an old time is indexed, one that can't be read keeps its usages; the stored resolution equals a new one."""
    from codeloom.operators import resolve
    root = tmp_path / "copy"
    shutil.copytree(repo, root, ignore=shutil.ignore_patterns(".codeloom"))
    (root / ".codeloom.toml").write_text("[repository]\nmax_file_bytes = 5000\n")
    (root / "src/huge.py").write_text("x = 1\n" * 2000)
    engine = CodeIndex(spark, root)
    counts = engine.index()
    assert counts["too_large_files"] == 1 and counts["indexed_files"] == 7
    assert [(r.path, r.skipped_reason) for r in engine.skipped_frame().collect()] == [("src/huge.py", "too_large")]
    moved = root / "src/moved.py"
    moved.write_text("def arrived(meter):\n    return meter.issue('k')\n")
    os.utime(moved, (1, 1))
    watch.watch_tree(spark, engine.store, root, engine.config, [], str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    engine.refresh()
    assert "arrived" in {r["name"] for r in engine.symbols.collect()}
    full = resolve.resolve_occurrences(engine.store.read("occurrences"), engine.symbols)
    assert sorted(map(repr, full.collect())) == sorted(map(repr, engine.occurrences.select(*full.columns).collect()))
    before = engine.find_usages("issue")
    moved.unlink()
    found = engine.find_usages("issue")
    usages = {u["file"]: u["snippet"] for g in found["usages_by_file"] for u in g["usages"]}
    assert found["total_found"] == before["total_found"] and usages["src/moved.py"] is None and usages["app/Desk.kt"]
    short = engine.find_usages("issue", limit=1)
    assert short["truncated"] and short["total_found"] == before["total_found"]
