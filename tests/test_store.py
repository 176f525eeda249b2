"""Scans of small trees: what's stored, skipped, unchanged and pruned."""

import io
import os
import tarfile

import pytest

from cairn import cli
from cairn.functions.content import Cancelled
from cairn.operators.rules import ARCHIVE, IGNORE, PRESETS, InvalidRule, ScanRule
from cairn.plans.store import ScanOptions, Store, normal_prefix
from cairn.workspace import Workspaces

CACHE = ScanRule(r"(^|/)cache$", ARCHIVE)


def plant(root, files: dict, folders=()):
    for f in folders:
        os.makedirs(root / f, exist_ok=True)
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())
        os.utime(at, (1_600_000_000, 1_600_000_000))
    return str(root)


@pytest.fixture
def place(spark, tmp_path):
    return tmp_path / "src", Store(spark, str(tmp_path / "store"))


def names(store, path):
    return [r.name for r in store.list_dir(path).collect()]


def pick(stats, *keys):
    return tuple(stats[k] for k in keys)


MAIN = ("total_files", "unique_blobs", "duplicate_files", "skipped_files")


def test_first_scan_rescan_change_and_lost_blob(place):
    src, store = place
    at = plant(src, {"hello.txt": "h", "bye.txt": "b", "subdir/nested.txt": "n"})
    s = store.scan(at)
    assert pick(s, "total_files", "total_dirs", "unique_blobs", "duplicate_files", "skipped_files") == (3, 1, 3, 0, 0)
    assert s["errors_log_path"] is None and store.get_file("/hello.txt").first().original_size == 1
    assert store.read_file("/subdir/nested.txt") == b"n"
    s = store.scan(at)
    assert pick(s, "total_files", "unchanged_files", "unique_blobs", "duplicate_files") == (3, 3, 0, 0)
    plant(src, {"hello.txt": "longer"})
    s = store.scan(at)
    assert pick(s, "unchanged_files", "unique_blobs") == (2, 1) and store.get_file("/hello.txt").first().original_size == 6
    for f in os.listdir(store.blobs.root):
        os.remove(os.path.join(store.blobs.root, f))
    assert pick(store.scan(at), "unchanged_files", "unique_blobs") == (0, 3)
    with pytest.raises(FileNotFoundError, match="file not found"):
        store.read_file("/nope")


def test_duplicates_and_targets(place):
    src, store = place
    s = store.scan(plant(src, {"file1.txt": "identical", "file2.txt": "identical", "unique.txt": "u"}), "/photos/vacation")
    assert pick(s, *MAIN) == (3, 2, 1, 0) and s["total_dirs"] == 1
    assert names(store, "/") == ["photos"] and names(store, "/photos/vacation/") == ["file1.txt", "file2.txt", "unique.txt"]
    assert store.find_duplicates("/photos/vacation/file1.txt") == ["/photos/vacation/file1.txt", "/photos/vacation/file2.txt"]
    with pytest.raises(FileNotFoundError):
        store.find_duplicates("/nope")
    t = store.compute_stats().first()
    assert (t.total_files, t.unique_blobs, t.duplicate_files, t.total_dirs) == (3, 2, 2, 2)
    assert normal_prefix("a/b/") == "/a/b" and normal_prefix("///") == "" == normal_prefix("/")


def test_presets_ignore(place):
    src, store = place
    at = plant(src, {"target/a": "1", "app/node_modules/b": "2", "service/.venv/c": "3", "other/venv/d": "4", "keep.txt": "k"})
    s = store.scan(at, "/repo", ScanOptions(rules=[PRESETS[k] for k in ("rust_target", "node_modules", "python_venv")]))
    assert pick(s, "total_files", "skipped_files") == (1, 4) and names(store, "/repo/target") == []


def test_archives(place):
    src, store = place
    at = plant(src, {"cache/sub/item": "i", "cache/a\\b": "x", "keep.txt": "k"})
    s = store.scan(at, "/repo", ScanOptions(rules=[CACHE]))
    assert s["total_files"] == 2
    with tarfile.open(fileobj=io.BytesIO(store.read_file("/repo/cache.tar"))) as tar:
        assert tar.getnames() == ["cache", "cache/a\\b", "cache/sub", "cache/sub/item"]
        assert all((m.uid, m.gid, m.mtime, m.uname) == (0, 0, 0, "") for m in tar.getmembers())
    assert store.get_file("/repo/cache.tar").first().permissions == 0o644


@pytest.mark.parametrize("files, folders, used, want, held", [
    ({"cache/x": "1", "cache.tar": "real"}, [], [CACHE], (1, 1), None),
    ({}, ["cache"], [CACHE], (1, 0), None),
    ({"file.txt": "f"}, [], [ScanRule("^$", ARCHIVE)], (1, 0), "/repo/file.txt"),
    ({".tar": "t"}, [], [ScanRule("^$", ARCHIVE)], (1, 0), "/repo/.tar"),
    ({"foo/.tar": "t"}, [], [ScanRule("^foo/$", ARCHIVE)], (1, 0), "/repo/foo/.tar"),
    ({"cache": "file"}, [], [CACHE], (0, 1), None),
    ({"cache/x": "1", "cache.tar": "real"}, [], [ScanRule(r"(^|/)cache$", IGNORE), CACHE], (1, 1), "/repo/cache.tar"),
    ({".git/HEAD": "h", ".git/refs/heads/main": "m"}, [], [], (2, 0), "/repo/.git/HEAD"),
    ({".git/HEAD": "h", ".git.tar/nested": "n"}, [], [PRESETS["git"]], (1, 1), "/repo/.git.tar"),
])
def test_rule_cases(place, files, folders, used, want, held):
    src, store = place
    src.mkdir()
    s = store.scan(plant(src, files, folders), "/repo", ScanOptions(rules=used))
    assert pick(s, "total_files", "skipped_files") == want
    assert held is None or store.get_file(held).count() == 1


def test_equal_git_directories_and_links(place, tmp_path):
    src, store = place
    at = plant(src, {f"{d}/.git/HEAD": "h" for d in ("one", "two")})
    s = store.scan(at, "/repo", ScanOptions(bundle_git_dirs=True))
    assert pick(s, *MAIN) == (2, 1, 1, 0)
    outside = plant(tmp_path / "outside", {"HEAD": "h"})
    os.makedirs(src / "three")
    os.symlink(outside, src / "three/.git")
    s = store.scan(at, "/repo", ScanOptions(bundle_git_dirs=True))
    assert store.get_file("/repo/three/.git.tar").count() == 0 and s["skipped_files"] == 1


def test_invalid_rule_stores_nothing(place):
    src, store = place
    with pytest.raises(InvalidRule, match="invalid scan rule regex"):
        store.scan(plant(src, {"file.txt": "f"}), "/", ScanOptions(rules=[ScanRule("[", IGNORE)]))
    assert store.paths().count() == 0 and os.listdir(store.blobs.root) == []


def test_prune(place):
    src, store = place
    at = plant(src, {"a.txt": "a", "b.txt": "b", "sub/c.txt": "c"})
    store.scan(at, "/one")
    store.scan(at, "/two")
    os.remove(src / "b.txt")
    assert store.scan(at, "/one")["pruned_entries"] == 0 and store.get_file("/one/b.txt").count() == 1
    assert store.scan(at, "/one", ScanOptions(prune_deleted=True))["pruned_entries"] == 1
    assert store.get_file("/one/b.txt").count() == 0 and store.get_file("/two/b.txt").count() == 1
    os.remove(src / "sub/c.txt")
    os.rmdir(src / "sub")
    assert store.scan(at, "/one", ScanOptions(prune_deleted=True))["pruned_entries"] == 2


def test_many_copies_serial_and_parallel_agree(place, spark, tmp_path):
    src, store = place
    at = plant(src, {f"dupes/{k}.txt": "same" for k in range(60)} | {"deep/" + "/".join("abcdefgh"[:k]) + f"/f{k}": str(k) for k in range(1, 8)})
    other = Store(spark, str(tmp_path / "other"))
    a, b = store.scan(at, "/", ScanOptions(parallelism=1)), other.scan(at, "/", ScanOptions(parallelism=8))
    assert a == b and pick(a, "unique_blobs", "duplicate_files") == (8, 59)
    assert sorted(map(tuple, store.paths().collect())) == sorted(map(tuple, other.paths().collect()))
    assert not [f for f in os.listdir(store.blobs.root) if f.endswith(".tmp")]


def test_broken_link_is_logged_and_additive_index(place):
    src, store = place
    at = plant(src, {"noext": "one", "copy": "one"})
    os.symlink("nowhere", src / "broken")
    s = store.scan(at, "/b", ScanOptions(index_mode="additive"))
    assert s["skipped_files"] == 1 and open(s["errors_log_path"]).read().count("/b/broken") == 1 and s["errors_log_path"].endswith("errors_b.log")
    plant(src, {"noext": "changed"})
    store.scan(at, "/b", ScanOptions(index_mode="additive"))
    assert store.find_duplicates("/b/copy") == ["/b/copy", "/b/noext"] and store.cid_paths().count() == 3
    store.scan(at, "/b")
    assert store.find_duplicates("/b/copy") == ["/b/copy"] and store.cid_paths().count() == 2


def test_cancel_leaves_the_catalog(place):
    src, store = place
    with pytest.raises(Cancelled, match="scan cancelled"):
        store.scan(plant(src, {"a.txt": "a"}), should_cancel=lambda: True)
    assert store.paths().count() == 0


def test_command_line_and_workspaces(place, spark, tmp_path, capsys):
    src, store = place
    at = plant(src, {"a.txt": "same", "b.txt": "same"})
    run = lambda *a: cli.main(["--store", store.root, *a], spark)
    assert run("scan", "--source", at, "--target", "/p") == 0 and run("ls", "/p") == 0 and run("info", "/p/a.txt") == 0 and run("duplicates") == 0
    shown = capsys.readouterr().out
    assert "Files:           2" in shown and "       4 B  a.txt" in shown and "/p/a.txt  (this file)" in shown and "2 copies" in shown
    assert run("cat", "/p/a.txt", "-o", str(tmp_path / "out")) == 0 and (tmp_path / "out").read_text() == "same"
    assert run("info", "/p/none") == 1

    w = Workspaces(str(tmp_path / "conf/workspaces.json"))
    one = w.import_store(spark, os.path.join(store.root, "CURRENT"), "old")
    assert one["tags"] == ["imported"] and one["stats"]["total_files"] == 2 and w.active()["id"] == one["id"]
    with pytest.raises(ValueError):
        w.import_store(spark, store.root, "again")
    two = w.create("new", "/elsewhere")
    w.record_scan(two["id"], {k: 1 for k in ("total_files", "total_dirs", "unique_blobs", "duplicate_files", "total_original_bytes", "total_stored_bytes")})
    w.delete(one["id"])
    assert Workspaces(w.path).active()["stats"]["scans_count"] == 1
    w.save_rules([{"id": "r", "label": "l", "pattern": "x", "action": "ignore"}])
    with pytest.raises(InvalidRule):
        w.save_rules([{"id": "q", "label": " ", "pattern": "x", "action": "ignore"}])
    other = Workspaces(str(tmp_path / "other.json"))
    other.merge(w.export())
    assert other.data["custom_scan_rules"] == w.data["custom_scan_rules"] and other.find(two["id"])
