"""A shell over a store: one command a line."""

from __future__ import annotations

import json
import shlex
import sys
import time
from collections.abc import Callable

from tidelog import errors
from tidelog.api.facade import Api
from tidelog.functions.codecs import latency, shown
from tidelog.sources.store import Store

HELP = """get KEY | put KEY VALUE | del KEY | scan [LO] [HI] [--rev] [--limit N] | count [LO] [HI]
query MODULE [JSON] | exec MODULE [JSON] | modules | triggers | drain | forks | pins | pin NAME [SEQNO] | unpin NAME
fork NAME PATH | delete-fork NAME | stats | seqno | compact | vacuum | help | quit      (- is an open bound, hex:... is bytes)"""


def _bytes(word: str) -> bytes:
    return bytes.fromhex(word[4:]) if word.startswith("hex:") else word.encode()


def _bound(words: list[str], k: int) -> bytes | None:
    return None if len(words) <= k or words[k] == "-" else _bytes(words[k])


class Shell:
    def __init__(self, store: Store, out: Callable[[str], None] = print):
        self.store, self.api, self.out = store, Api(store), out

    def run(self, line: str) -> bool:
        """One command; whether to go on. What goes wrong is printed with its code."""
        try:
            words = shlex.split(line)
            if not words:
                return True
            if words[0] in ("quit", "exit"):
                return False
            start = time.perf_counter()
            for text in self._command(words[0], words[1:]):
                self.out(text)
            self.out(latency(time.perf_counter() - start))
        except errors.StoreError as error:
            self.out(f"error {error.code}: {error}")
        except (ValueError, IndexError) as error:
            self.out(f"usage: {error}\n{HELP}")
        return True

    def _command(self, name: str, words: list[str]):
        if name == "get":
            value = self.store.get(_bytes(words[0]))
            yield "(none)" if value is None else shown(value)
        elif name == "put":
            yield f"seqno {self.store.put(_bytes(words[0]), _bytes(words[1]))}"
        elif name == "del":
            yield f"seqno {self.store.delete(_bytes(words[0]))}"
        elif name == "scan":
            reverse, limit = "--rev" in words, 50
            if "--limit" in words:
                limit = int(words[words.index("--limit") + 1])
                del words[words.index("--limit") : words.index("--limit") + 2]
            words = [w for w in words if w != "--rev"]
            pairs, more = self.api.page(_bound(words, 0), _bound(words, 1), reverse=reverse, limit=limit)
            for k, v in pairs:
                yield f"{shown(k)} = {shown(v)}"
            yield f"{len(pairs)} entries" + (", more follow" if more else "")
        elif name == "count":
            yield str(self.api.count(_bound(words, 0), _bound(words, 1)))
        elif name in ("query", "exec"):
            args = json.loads(words[1]) if len(words) > 1 else None
            yield json.dumps(self.api.wasm(words[0], args) if name == "query" else self.api.wasmExecute(words[0], args))
        elif name in ("modules", "triggers", "forks", "pins", "stats"):
            for row in getattr(self.api, name)():
                yield json.dumps(row, default=str)
        elif name == "drain":
            yield json.dumps(self.store.drain_all())
        elif name == "pin":
            yield str(self.api.pin(words[0], int(words[1]) if len(words) > 1 else None))
        elif name == "unpin":
            yield str(self.api.unpin(words[0]))
        elif name == "fork":
            yield json.dumps(self.api.fork(words[0], words[1]))
        elif name == "delete-fork":
            yield str(self.api.deleteFork(words[0]))
        elif name == "seqno":
            yield str(self.api.seqno())
        elif name == "compact":
            yield str(self.api.compactAll())
        elif name == "vacuum":
            yield f"{self.api.gcVlog()} deleted"
        elif name == "help":
            yield HELP
        else:
            raise ValueError(f"no command {name}")


def main() -> None:
    from tidelog.session import session

    path = sys.argv[1]
    spark = session()
    try:
        store = Store(spark, path)
    except errors.InvalidArgument:
        store = Store.create(spark, path)
    shell = Shell(store)
    for line in sys.stdin:
        if not shell.run(line):
            break


if __name__ == "__main__":
    main()
