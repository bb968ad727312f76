"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed side by side into multiword Shift-And masks: one bit per
pattern position, 64 positions a word.  One step reads one byte of a whole
column of URLs and advances every pattern of every URL at once:

    D = ((D << 1) & enter[byte]) | (D & stay[byte])

``enter`` has the bytes that lead into a position, ``stay`` the bytes that a
wildcard before it may swallow.  The cost is (bytes of URL) x (words of masks),
whatever the number of wildcards.

Glob syntax, over the bytes of a canonical URL ``.host/path``: ``?`` is any one
byte but ``/``, ``*`` any run without ``/``, ``**`` any run, the rest stands for
itself.  A glob has to match the whole URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import UPPER, named

#: URL bytes times mask words that are held at once.
CELLS = 1 << 22


class Rule(NamedTuple):
    """``pattern``: ``host/path`` (a host with its subdomains and a path prefix) or, with ``glob``, a glob."""

    pattern: str
    verdict: str
    glob: bool = False


def rule_glob(pattern: str) -> str:
    """The glob of a host and path rule; the rule's own text has no wildcards."""
    return "*." + pattern + "**"


class ShiftAnd:
    """Masks of ``globs``; ``match`` tells for each text which globs match it."""

    def __init__(self, globs: Sequence[tuple[str, bool]]):
        """globs: (text, whether ``?`` and inner ``*`` are wildcards); a leading ``*.`` and a closing ``**`` always are."""
        enters: list[frozenset[int]] = []
        stays: list[frozenset[int]] = []
        every, inside = frozenset(range(256)), frozenset(range(256)) - {ord("/")}
        starts, ends = [], []
        for glob, wild in globs:
            raw = glob.encode()
            starts.append(len(enters))
            enters.append(frozenset())
            stays.append(frozenset())
            i = 0
            while i < len(raw):
                closing, leading = raw[i:] == b"**", i == 0 and raw[:2] == b"*."
                if raw[i : i + 2] == b"**" and (wild or closing):
                    stays[-1], i = every, i + 2
                elif raw[i] == ord("*") and (wild or leading):
                    stays[-1], i = stays[-1] | inside, i + 1
                else:
                    enters.append(inside if wild and raw[i] == ord("?") else frozenset({raw[i]}))
                    stays.append(frozenset())
                    i += 1
            ends.append(len(enters) - 1)
        self.words = max(1, -(-len(enters) // 64))
        self.enter, self.stay = self._pack(enters), self._pack(stays)
        self.first = self._pack([frozenset({0}) if i in set(starts) else frozenset() for i in range(len(enters))])[0]
        self.ends = [(e // 64, np.uint64(1) << np.uint64(e % 64)) for e in ends]

    def _pack(self, sets: list[frozenset[int]]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for i, bytes_ in enumerate(sets):
            out[list(bytes_), i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """bool[texts, globs]; texts are taken in order of length, so that few padded bytes are read."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        size = np.array([len(t) for t in texts], np.int64)
        order, at = np.argsort(size, kind="stable"), 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * self.words <= CELLS and (n + 1) * size[order[at + n]] <= max(CELLS, size[order[at]]) and size[order[at + n]] <= 2 * size[order[at]] + 64:
                n += 1
            rows = order[at : at + n]
            out[rows] = self._run([texts[r] for r in rows], size[rows])
            at += n
        return out

    def _run(self, texts: list[bytes], size: np.ndarray) -> np.ndarray:
        width, one, top = int(size.max(initial=0)), np.uint64(1), np.uint64(63)
        cells = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
        d = np.repeat(self.first[None], len(texts), 0)
        for j in range(width):
            c = cells[:, j]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            new = (moved & self.enter[c]) | (d & self.stay[c])
            d = np.where((j < size)[:, None], new, d)
        return np.stack([(d[:, w] & bit) != 0 for w, bit in self.ends], axis=1) if self.ends else np.zeros((len(texts), 0), bool)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: on up to ``?``, ``#`` or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule], *, default: str = "allow", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Of the host and path rules that fit, the longest decides (of equally long
    ones the first); where none fits, the first glob rule that matches, else
    ``default``; ``rule`` is then null.  A null URL, or one without ``://``, has
    an empty host and path.  Rows are judged one by one: repeated rows and null
    ids give a row each, other columns are not read.
    """
    sited = [r for r in rules if not r.glob]
    globbed = [r for r in rules if r.glob]
    automaton = ShiftAnd([(rule_glob(r.pattern), False) for r in sited] + [(r.pattern, True) for r in globbed])
    rank = sorted(range(len(sited)), key=lambda i: (-len(sited[i].pattern), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hits = automaton.match([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            rule: list[str | None] = [None] * len(hosts)
            verdict = [default] * len(hosts)
            for i in range(len(sited) + len(globbed) - 1, len(sited) - 1, -1):
                for n in np.flatnonzero(hits[:, i]):
                    verdict[n] = globbed[i - len(sited)].verdict
            for i in reversed(rank):
                for n in np.flatnonzero(hits[:, i]):
                    rule[n], verdict[n] = sited[i].pattern, sited[i].verdict
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(*named([url]))
    rows = pages.select(*named([id_col], ["id"]), host.alias("host"), path.alias("path"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
