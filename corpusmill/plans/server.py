"""A search server over the derived tables: descriptors and messages.

Messages are JSON-RPC, one per line. The answers are the retrieval operators' rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import retrieval

VERSION = "2024-11-05"
NO_METHOD, FAILED = -32601, -32603


def _text(about: str, **extra: object) -> dict:
    return {"type": "string", "description": about, **extra}


def tools() -> list[dict]:
    """What can be asked."""
    shapes = {
        "search_docs": ("Documents whose title, tags, path or description hold the words", {"query": _text("words"), "limit": {"type": "integer", "default": 5}}, ["query"]),
        "get_document": ("One document with its text", {"path": _text("relative path")}, ["path"]),
        "list_documents": ("Documents of a section or with a tag", {"section": _text("section"), "tags": {"type": "array", "items": {"type": "string"}}}, []),
        "get_section": ("All documents of a section", {"section": _text("section")}, ["section"]),
    }
    schema = lambda properties, required: dict(required=required, properties=properties, type="object")
    return [dict(name=n, inputSchema=schema(p, r), description=d) for n, (d, p, r) in shapes.items()]


def prompts() -> list[dict]:
    """Prepared questions."""
    say = lambda name, about, *need: {"name": name, "description": about, "arguments": [{"name": n, "required": True} for n in need]}
    return [say("summarize_section", "Summarize the documents of a section", "section"), say("answer", "Answer a question from the documents", "question"), say("compare", "Compare two documents", "first", "second")]


def splitter() -> dict:
    """How loaders split texts."""
    return {"chunk_size": 1000, "chunk_overlap": 200, "separators": ["\n## ", "\n### ", "\n\n", "\n", " ", ""]}


def client_config(name: str, command: str, *arguments: str) -> dict:
    """An entry for a client's list of servers."""
    return {"mcpServers": {name: {"command": command, "args": list(arguments)}}}


def write_configs(folder: str, name: str, command: str, *arguments: str) -> list[str]:
    """The descriptors as files: tools, prompts and splitter of the server; the server; an entry for clients."""
    from corpusmill.plans import sinks

    parts = {
        "mcp.config.json": {"name": name, "protocolVersion": VERSION, "tools": tools(), "prompts": prompts(), "splitter": splitter()},
        "mcp.server.json": {"name": name, "command": command, "args": list(arguments)},
        "mcp.client.json": client_config(name, command, *arguments),
    }
    for file, value in parts.items():
        sinks.write_json(value, f"{folder}/{file}")
    return sorted(parts)


class Server:
    """Answers over an index (``retrieval.doc_index``) and the documents."""

    def __init__(self, index: DataFrame, docs: DataFrame, name: str = "corpusmill"):
        self.index, self.docs, self.name = index, docs, name
        self.methods: dict[str, Callable[[dict], object]] = {
            "initialize": lambda _: {"protocolVersion": VERSION, "serverInfo": {"name": name, "version": "1"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}},
            "tools/list": lambda _: {"tools": tools()},
            "tools/call": self.call,
            "resources/list": lambda _: {"resources": self.resources()},
            "resources/read": self.read,
            "prompts/list": lambda _: {"prompts": prompts()},
            "prompts/get": self.prompt,
        }

    def resources(self) -> list[dict]:
        """One per section, with its number of documents."""
        rows = self.index.groupBy("section").agg(F.count("*").alias("n")).orderBy("section").collect()
        return [{"uri": f"docs://section/{r.section}", "name": r.section, "description": f"{r.n} documents", "mimeType": "application/json"} for r in rows]

    def call(self, given: dict) -> dict:
        name, a = given["name"], given.get("arguments") or {}
        if name == "search_docs":
            found = retrieval.search_docs(self.index, a["query"], int(a.get("limit", 5)))
        elif name == "get_document":
            found = retrieval.get_document(self.docs, a["path"]).select("path", "content")
        elif name == "list_documents":
            found = retrieval.list_documents(self.index, a.get("section"), a.get("tags") or ()).orderBy("path")
        elif name == "get_section":
            found = retrieval.list_documents(self.index, a["section"]).orderBy("path")
        else:
            raise KeyError(f"no tool {name}")
        return {"content": [{"type": "text", "text": "[" + ",".join(found.toJSON().collect()) + "]"}]}

    def read(self, given: dict) -> dict:
        uri = given["uri"]
        kind, _, name = uri.removeprefix("docs://").partition("/")
        if kind != "section":
            raise KeyError(f"no resource {uri}")
        rows = retrieval.list_documents(self.index, name).orderBy("path").toJSON().collect()
        return {"contents": [{"uri": uri, "mimeType": "application/json", "text": "[" + ",".join(rows) + "]"}]}

    def prompt(self, given: dict) -> dict:
        found = next((p for p in prompts() if p["name"] == given["name"]), None)
        if found is None:
            raise KeyError(f"no prompt {given['name']}")
        values = ", ".join(f"{k}: {v}" for k, v in (given.get("arguments") or {}).items())
        return {"messages": [{"role": "user", "content": {"type": "text", "text": f"{found['description']} ({values})"}}]}

    def handle(self, message: dict) -> dict | None:
        """The answer to a message; None to a notification."""
        if "id" not in message:
            return None
        answer = {"jsonrpc": "2.0", "id": message["id"]}
        method = self.methods.get(message.get("method", ""))
        if method is None:
            return answer | {"error": {"code": NO_METHOD, "message": f"no method {message.get('method')}"}}
        try:
            return answer | {"result": method(message.get("params") or {})}
        except Exception as error:  # noqa: BLE001 - an answer is due whatever went wrong
            return answer | {"error": {"code": FAILED, "message": str(error)[:500]}}

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip():
                try:
                    answer = self.handle(json.loads(line))
                except ValueError:
                    answer = {"jsonrpc": "2.0", "id": None, "error": {"code": FAILED, "message": "no JSON"}}
                if answer is not None:
                    yield json.dumps(answer)
