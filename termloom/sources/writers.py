"""Snapshots and copies of index folders.

Segments never change once written, so a copy takes what is missing, then the manifest, and only then
lets go of what the manifest no longer names: a reader of the target sees the old state or the new one.
"""

from __future__ import annotations

import json
import os
import shutil


def _atomic(path: str, text: str) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def snapshot(root: str, target: str) -> str:
    """A copy of an index folder as it stands; the target must not exist."""
    shutil.copytree(root, target, ignore=shutil.ignore_patterns("*.tmp", "claim-*"))
    return target


def replicate(root: str, target: str) -> dict:
    """Brings ``target`` to the state of ``root``; counts of segments copied and pruned."""
    with open(os.path.join(root, "manifest.json")) as f:
        manifest = json.load(f)
    os.makedirs(target, exist_ok=True)
    names, copied = [s["dir"] for s in manifest["segments"]], 0
    for name in [*names, *filter(None, [manifest.get("tombstones")])]:
        if not os.path.exists(os.path.join(target, name)):
            shutil.copytree(os.path.join(root, name), os.path.join(target, f"{name}.tmp"), dirs_exist_ok=True)
            os.replace(os.path.join(target, f"{name}.tmp"), os.path.join(target, name))
            copied += name in names
    _atomic(os.path.join(target, "manifest.json"), json.dumps(manifest))
    keep = {*names, manifest.get("tombstones"), "manifest.json"}
    gone = [x for x in os.listdir(target) if x not in keep and not x.startswith("claim-")]
    for x in gone:
        path = os.path.join(target, x)
        shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
    return {"copied": copied, "pruned": sum(x.startswith("seg-") for x in gone)}
