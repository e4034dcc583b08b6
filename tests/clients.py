"""Clients of the paged source for tests; they note each call in a folder that all tasks see."""

import json
import os
import time
import uuid

from kgspark.sources.paged import SourceError


def _note(folder, what):
    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
        json.dump({"t": time.time(), **what}, f)


def noted(seed, cursor, page_size):
    """Rows 0 to seed["n"]; seeds with "fail" fail on their second page, for good or the first time only."""
    _note(seed["folder"], {"seed": seed["id"], "cursor": cursor})
    if cursor and seed.get("fail") == "good":
        raise SourceError("gone")
    if cursor and seed.get("fail") == "once":
        flag = f"{seed['folder']}.{seed['id']}.once"
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("for now")
    at = cursor or 0
    rows = [json.dumps({"id": seed["id"], "k": k, "date": f"2024-01-{28 - k:02}"}) for k in range(at, min(seed["n"], at + page_size))]
    return rows, at + page_size if at + page_size < seed["n"] else None


def noted_end(seed):
    return seed["n"]


def notes(folder):
    return [json.load(open(f"{folder}/{f}")) for f in os.listdir(folder)]
