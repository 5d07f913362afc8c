"""Writes session files for tests."""

import hashlib
import json

A, B = "/tmp/skein-fixtures/project-a", "/tmp/skein-fixtures/project-b"
KEY_A, KEY_B = (hashlib.sha256(f"v1|cwd|{x}".encode()).hexdigest() for x in (A, B))


def digits(n):
    return "-".join(str(n) * k for k in (8, 4, 4, 4, 12))


def header(id, cwd=A, parent=None, **more):
    return {"type": "session", "version": 3, "id": id, "timestamp": "2026-01-01T00:00:00.000Z", "cwd": cwd, **({"parentSession": parent} if parent else {}), **more}


def message(id, role, text, parent=None, **more):
    return {"type": "message", "id": id, "parentId": parent, "timestamp": "2026-01-01T00:00:01.000Z", "message": {"role": role, "content": text, **more}}


def write(path, *rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows)
    path.write_text(text if end == "\n" else text[:-1] + end)
    return path
