"""A small shell over a store: ``python -m palimpsest.cli PATH``."""

from __future__ import annotations

import sys

from palimpsest.session import local_session
from palimpsest.store import Store

ARITY = {"set": (2, 2), "get": (1, 2), "delete": (1, 1), "scan": (2, 2), "stats": (0, 0), "exit": (0, 0)}


def answer(store: Store, line: str) -> str | None:
    """The reply to one line; None ends the shell."""
    name, *args = line.split() or [""]
    name = name.lower()
    if name not in ARITY:
        return f"unknown command: {name}"
    low, high = ARITY[name]
    if not low <= len(args) <= high:
        return f"{name.upper()} takes {low if low == high else f'{low} or {high}'} arguments"
    if name == "exit":
        return None
    if name == "set":
        store.set(*args)
        return "ok"
    if name == "delete":
        store.delete(*args)
        return "ok"
    if name == "get":
        if len(args) == 2 and not args[1].lstrip("-").isdigit():
            return "a sequence number is needed"
        found = store.get(args[0], int(args[1]) if len(args) == 2 else None)
        return "(none)" if found is None else found
    if name == "scan":
        return "\n".join(f"{k} {v}" for k, v in store.iter(*args)) or "(none)"
    return "\n".join(f"{k}: {v}" for k, v in store.stats().items())


def main() -> None:
    with Store(local_session(), sys.argv[1]) as store:
        for line in sys.stdin:
            reply = answer(store, line)
            if reply is None:
                return
            print(reply, flush=True)


if __name__ == "__main__":
    main()
