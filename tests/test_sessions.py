import pytest
from files import A, digits, header, message, write

from skein.sources import sessions as S


def load(spark, *paths):
    files = S.read(spark, [str(p) for p in paths])
    split = S.lines(files)
    heads = S.headers(split, files)
    return files, split, heads, S.parsed(split, heads)


def test_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes("é\r\n\nb\rc\n  \ntorn".encode())
    got = [(r.pos, r.byte_offset, r.line) for r in S.lines(S.read(spark, [str(path)])).orderBy("pos").collect()]
    assert got == [(0, 0, "é"), (1, 5, "b\rc"), (2, 9, "  ")]


def test_headers(spark, tmp_path):
    rows = {
        "ok": header("s1", parent="p.jsonl"), "old": header("s2") | {"version": 2}, "type": {"type": "x"}, "version": header("s") | {"version": "3"}, "fields": header("s") | {"cwd": 1}, "json": "not json", "list": "[1]",
    }
    paths = [write(tmp_path / f"{k}.jsonl", v) for k, v in rows.items()]
    empty = tmp_path / "empty.jsonl"
    empty.write_text("")
    _, _, heads, _ = load(spark, *paths, empty)
    got = {r.path.rsplit("/", 1)[1][:-6]: (r.status, r.detail, r.session_id, r.parent_session) for r in heads.collect()}
    assert got["ok"] == ("ok", None, "s1", "p.jsonl")
    assert got["old"] == ("legacy-unsupported", "v2", None, None)
    assert {k: got[k][:2] for k in ("type", "version", "fields", "json", "list", "empty")} == {
        "type": ("header-invalid", "type"), "version": ("header-invalid", "version"), "fields": ("header-invalid", "fields"), "json": ("header-invalid", "type"), "list": ("header-invalid", "type"), "empty": ("header-invalid", "type"),
    }


def test_entries(spark, tmp_path):
    blocks = [{"type": "thinking", "thinking": "no"}, {"type": "text", "text": ""}, {"type": "text", "text": "one"}, 5, {"type": "text", "text": 5}, {"type": "text", "text": "two"}]
    path = write(
        tmp_path / "s.jsonl", header(digits(1)), message("e1", "user", "hello"), message("e2", "assistant", blocks, "e1"), message("e3", "toolResult", "hidden"), "broken {", "[1]", {"id": "x"},
        {"type": "mystery", "id": "m", "parentId": None, "timestamp": "t"}, {"type": "compaction", "id": "c", "timestamp": "t"}, {"type": "custom", "id": "d", "parentId": 5, "timestamp": "t"},
        {"type": "message", "id": "n", "parentId": None, "timestamp": "t", "message": {"content": "x"}}, "x" * 1_100_000, message("e4", "user", ""),
    )
    _, _, heads, rows = load(spark, path)
    got = {r.entry_id: (r.type, r.role, r.parent_id, r.text_blocks) for r in S.entries(rows).collect()}
    assert got == {
        "e1": ("message", "user", None, ["hello"]), "e2": ("message", "assistant", "e1", ["one", "two"]), "e3": ("message", "toolResult", None, []), "e4": ("message", "user", None, []), "m": ("mystery", None, None, None),
    }
    bad = sorted((r.code, r.detail or "") for r in S.diagnostics(heads, rows).collect())
    assert bad == [("entry-malformed", x) for x in ("entry-base", "json", "message", "missing-type", "not-object", "parentId", "unknown-type")] + [("entry-oversized", "")]


def test_files(spark, tmp_path):
    inside = write(tmp_path / "r/sub/a.jsonl", header("s"))
    (tmp_path / "r/link.jsonl").symlink_to(inside)
    (tmp_path / "r/other.txt").write_text("x")
    assert S.discover([str(tmp_path / "r"), str(tmp_path / "missing")]) == [str(inside)]
    assert S.assert_readable(str(inside), [str(tmp_path / "r")]) == str(inside)
    for path, why in ((tmp_path / "r/link.jsonl", "not-regular-file"), (tmp_path / "x", "outside"), (tmp_path / "r/none", "missing")):
        with pytest.raises(S.PathRejected, match=why):
            S.assert_readable(str(path), [str(tmp_path / "r")])
    with pytest.raises(S.SizeLimitExceeded):
        S.read(spark, [str(inside)], most_bytes=10)
    assert A.startswith("/tmp")
