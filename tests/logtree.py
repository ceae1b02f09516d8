"""Small log trees for tests."""

from __future__ import annotations

import json
import pathlib


def write_session(root: pathlib.Path, project: str, session: str, records: list, subagents: dict[str, list] | None = None) -> None:
    folder = root / "projects" / project
    folder.mkdir(parents=True, exist_ok=True)
    dump = lambda rows: "".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows)
    (folder / f"{session}.jsonl").write_text(dump(records), encoding="utf-8")
    for name, rows in (subagents or {}).items():
        path = folder / session / "subagents" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(dump(rows), encoding="utf-8")


def usage(i: int, o: int, w: int, r: int, **more) -> dict:
    return {"input_tokens": i, "output_tokens": o, "cache_creation_input_tokens": w, "cache_read_input_tokens": r, **more}


def user(ts, content, **more) -> dict:
    return {"type": "user", "sessionId": "s", "timestamp": ts, "message": {"role": "user", "content": content}, **more}


def assistant(ts, content, ident=None, model="claude-opus-4", use=None, stop=None, **more) -> dict:
    message = {"role": "assistant", "model": model, "content": content}
    if ident is not None:
        message["id"] = ident
    if use is not None:
        message["usage"] = use
    if stop is not None:
        message["stop_reason"] = stop
    return {"type": "assistant", "sessionId": "s", "timestamp": ts, "message": message, **more}


def tool_use(ident, name, **given) -> dict:
    return {"type": "tool_use", "id": ident, "name": name, "input": given}


def tool_result(ident, content) -> dict:
    return {"type": "tool_result", "tool_use_id": ident, "content": content}
