"""Workspaces and saved rules: one small JSON document on the driver, saved atomically."""

from __future__ import annotations

import copy
import json
import os
import time
import uuid
from collections.abc import Callable

from cairn.operators import rules

STATS = {"total_files": 0, "total_dirs": 0, "unique_blobs": 0, "duplicate_files": 0, "total_original_bytes": 0, "total_stored_bytes": 0, "scans_count": 0, "last_scan_at": 0}
SUMMED = ("total_files", "total_dirs", "unique_blobs", "duplicate_files", "total_original_bytes", "total_stored_bytes")


def new_id() -> str:
    return f"ws_{time.time_ns():x}"


class Workspaces:
    """``active_workspace_id``: an id or None; ``workspaces`` and ``custom_scan_rules``: lists of dicts. Missing fields take their defaults."""

    def __init__(self, path: str):
        self.path, self.data = path, {"active_workspace_id": None, "workspaces": [], "custom_scan_rules": []}
        if os.path.exists(path):
            with open(path) as f:
                self.data |= json.load(f)
        for w in self.data["workspaces"]:
            w["stats"] = STATS | w.get("stats", {})
            w.setdefault("tags", [])
        for r in self.data["custom_scan_rules"]:
            r.setdefault("enabled", True)

    def save(self) -> None:
        own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        try:
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            with open(own, "w") as f:
                json.dump(self.data, f, indent=2)
            os.replace(own, self.path)
        finally:
            if os.path.exists(own):
                os.remove(own)

    def update(self, change: Callable[[dict], None]) -> dict:
        """Apply ``change`` and save; if either fails nothing has changed."""
        was = copy.deepcopy(self.data)
        try:
            change(self.data)
            self.save()
        except BaseException:
            self.data = was
            raise
        return self.data

    def find(self, ident: str) -> dict | None:
        return next((w for w in self.data["workspaces"] if w["id"] == ident), None)

    def active(self) -> dict | None:
        return self.find(self.data["active_workspace_id"])

    def create(self, label: str, store_path: str, tags: list[str] = (), stats: dict | None = None) -> dict:
        made = {"id": new_id(), "label": label, "tags": list(tags), "store_path": store_path, "created_at": int(time.time()), "stats": STATS | (stats or {})}

        def change(data: dict) -> None:
            data["workspaces"].append(made)
            if data["active_workspace_id"] is None:
                data["active_workspace_id"] = made["id"]

        self.update(change)
        return made

    def switch(self, ident: str) -> dict:
        if not self.find(ident):
            raise KeyError(f"workspace not found: {ident}")
        self.update(lambda data: data.update(active_workspace_id=ident))
        return self.active()

    def delete(self, ident: str) -> None:
        def change(data: dict) -> None:
            data["workspaces"] = [w for w in data["workspaces"] if w["id"] != ident]
            if data["active_workspace_id"] == ident:
                data["active_workspace_id"] = data["workspaces"][0]["id"] if data["workspaces"] else None

        self.update(change)

    def save_rules(self, incoming: list[dict]) -> list[dict]:
        """Replace rules by id and add new ones, all of them checked first."""
        for r in incoming:
            rules.check_custom(r)

        def change(data: dict) -> None:
            by_id = {r["id"]: r for r in data["custom_scan_rules"]}
            by_id.update({r["id"]: {"enabled": True} | r for r in incoming})
            data["custom_scan_rules"] = list(by_id.values())

        return self.update(change)["custom_scan_rules"]

    def record_scan(self, ident: str, stats: dict) -> None:
        """Add a scan's counts; unchanged and pruned entries aren't accumulated."""

        def change(data: dict) -> None:
            s = next(w for w in data["workspaces"] if w["id"] == ident)["stats"]
            for k in SUMMED:
                s[k] += stats[k]
            s["scans_count"] += 1
            s["last_scan_at"] = int(time.time())

        self.update(change)

    def export(self) -> str:
        return json.dumps(self.data, indent=2)

    def merge(self, text: str) -> dict:
        """Add workspaces with new ids, and rules by id."""
        other = json.loads(text)
        for r in other.get("custom_scan_rules", []):
            rules.check_custom(r)

        def change(data: dict) -> None:
            known = {w["id"] for w in data["workspaces"]}
            data["workspaces"] += [w | {"stats": STATS | w.get("stats", {})} for w in other.get("workspaces", []) if w["id"] not in known]
            by_id = {r["id"]: r for r in data["custom_scan_rules"]}
            by_id.update({r["id"]: {"enabled": True} | r for r in other.get("custom_scan_rules", [])})
            data["custom_scan_rules"] = list(by_id.values())

        return self.update(change)

    def import_store(self, spark, store_path: str, label: str) -> dict:
        """Take up a store that exists: its folder, or its ``CURRENT`` file."""
        from cairn.plans.store import Store

        at = os.path.abspath(os.path.dirname(store_path) if os.path.basename(store_path) == "CURRENT" else store_path)
        if not os.path.exists(os.path.join(at, "CURRENT")):
            raise FileNotFoundError(f"no catalog in {at}")
        if any(os.path.abspath(w["store_path"]) == at for w in self.data["workspaces"]):
            raise ValueError(f"already a workspace: {at}")
        stats = Store(spark, at).compute_stats().first().asDict()
        return self.create(label, at, ["imported"], {k: stats[k] for k in SUMMED})
