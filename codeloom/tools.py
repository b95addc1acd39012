"""Tool descriptions and the line-based JSON-RPC front of the engine."""

import json
import sys

from codeloom import __version__


def _tool(name, description, required=(), **properties):
    return {"name": name, "description": description,
            "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in properties.items()}, "required": list(required)}}


TOOLS = [
    _tool("search_semantic", "Search symbols, docs, call sites and file names.", ["query"], query="string", path_prefix="string",
          kinds="array", limit="integer", context_symbol="string"),
    _tool("get_context", "Documentation and symbols of a feature.", ["feature"], feature="string", path_prefix="string", max_chars="integer"),
    _tool("get_skeleton", "A file without its function bodies.", ["file_path"], file_path="string", max_chars="integer"),
    _tool("get_symbol_code", "Code of one symbol.", ["symbol"], symbol="string", context_lines="integer", kind="string",
          class_context="string", force="boolean"),
    _tool("find_usages", "Usages of a symbol with confidence.", ["symbol"], symbol="string", limit="integer", include_probable="boolean",
          kind="string", class_context="string", min_confidence="number"),
    _tool("find_implementations", "Types that implement or extend a type.", ["symbol"], symbol="string", transitive="boolean"),
    _tool("explore_flow", "A symbol with its callees, callers and docs.", ["symbol"], symbol="string", max_depth="integer",
          max_chars="integer", force="boolean"),
    _tool("analyze_impact", "Callers, implementers and tests a change affects.", ["symbol"], symbol="string", depth="integer",
          include_tests="boolean", max_chars="integer"),
    _tool("read_file_structural", "Lines of a file with its symbols, dependents and docs.", ["file_path"], file_path="string",
          start="integer", end="integer", max_chars="integer"),
    _tool("read_lines", "A slice of lines.", ["file_path", "start", "end"], file_path="string", start="integer", end="integer"),
    _tool("get_file_tree", "Indexed files below a directory.", dir_path="string", depth="integer", max_entries="integer"),
    _tool("index_status", "Counts of the index."),
]


class Rpc:
    def __init__(self, index):
        self.index = index

    def handle(self, request: dict) -> dict | None:
        method, params, ident = request.get("method"), request.get("params") or {}, request.get("id")

        def reply(**body):
            return {"jsonrpc": "2.0", "id": ident, **body}
        if method == "initialize":
            return reply(result={"protocolVersion": "2024-11-05", "serverInfo": {"name": "codeloom", "version": __version__},
                                 "capabilities": {"tools": {"listChanged": False}}})
        if method == "notifications/initialized":
            return None
        if method == "ping":
            return reply(result={})
        if method == "tools/list":
            return reply(result={"tools": TOOLS})
        if method != "tools/call":
            return reply(error={"code": -32601, "message": f"Unknown method: {method}"})
        self.index.session.next_turn()
        name = params.get("name")
        if name not in {t["name"] for t in TOOLS}:
            return reply(error={"code": -32601, "message": f"Method/Tool '{name}' not found"})
        try:
            answer = json.dumps(getattr(self.index, name)(**params.get("arguments", {})), indent=2)
            failed = False
        except Exception as error:  # the protocol reports tool failures as results
            answer, failed = f"Error: {error}", True
        return reply(result={"content": [{"type": "text", "text": answer}], "isError": failed})

    def run(self, lines=sys.stdin, out=sys.stdout):
        for line in lines:
            try:
                request = json.loads(line)
            except ValueError:
                continue
            response = self.handle(request)
            if response is not None:
                out.write(json.dumps(response) + "\n")
                out.flush()
