"""URL filter on a sorted array of 64-bit digests.

The list's entries are host and path prefixes and single words of hosts. Their xxhash digests are sorted into one
file that every executor memory-maps. A URL is probed with all entries that could fit it: host suffixes and
path prefixes of the lengths that occur in the list. A vectorised binary search finds the digests, and the
stored string is compared before a hit counts, so that collisions do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, ship, widened

# Bound of a list held by every executor; cut a longer one into several and take the longest of their rules.
MAX_LIST_BYTES = 256 << 20
ALLOW, BLOCK = "allow", "block"
# Kind of entry, the first character of a stored string.
RULE, WORD = "r", "w"
# Words of host names (split at dots and hyphens) of kinds of sites that a training set leaves out.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez", "xxx")


def digest(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode())


def build_list(rules: list[tuple[str, str, str]], words: tuple[str, ...] = ()) -> bytes:
    """File of the list: entry count, sorted digests, offsets of the strings, verdicts, host lengths, strings.

    ``rules`` are (host, path, verdict). For a rule given twice, block wins.
    """
    entries: dict[str, tuple[str, int]] = {}
    for host, path, verdict in rules:
        if verdict not in (ALLOW, BLOCK) or not host or not path.startswith("/"):
            raise ValueError(f"not a rule: {(host, path, verdict)}")
        key = f"{RULE}{host}{path}"
        if entries.get(key, ("",))[0] != BLOCK:
            entries[key] = (verdict, len(host))
    entries |= {f"{WORD}{w}": (BLOCK, 0) for w in words}
    order = sorted(entries, key=lambda e: (digest(e), e))
    texts = [e.encode() for e in order]
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    out = b"".join([
        np.array([len(order)], np.int64).tobytes(),
        np.array([digest(e) for e in order], np.uint64).tobytes(),
        offsets.tobytes(),
        np.array([entries[e][1] for e in order], np.int64).tobytes(),
        np.array([entries[e][0] == BLOCK for e in order], np.uint8).tobytes(),
        b"".join(texts),
    ])
    if len(out) > MAX_LIST_BYTES:
        raise ValueError("the list exceeds the bound of what an executor maps")
    return out


class DigestList:
    """The file of :func:`build_list`, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        ends = np.cumsum([8, 8 * n, 8 * (n + 1), 8 * n, n])
        self.keys = raw[8 : ends[1]].view(np.uint64)
        self.offsets = raw[ends[1] : ends[2]].view(np.int64)
        self.host_lengths = raw[ends[2] : ends[3]].view(np.int64)
        self.blocks = raw[ends[3] : ends[4]]
        self.strings = raw[ends[4] :]
        sizes = np.diff(self.offsets)
        rules = self.host_lengths > 0
        # Lengths of host and path that occur, each pair once.
        pairs = np.stack([self.host_lengths[rules], sizes[rules] - 1 - self.host_lengths[rules]], 1)
        self.shapes = [tuple(x) for x in np.unique(pairs, axis=0).tolist()] if len(pairs) else []
        self.has_words = bool((~rules).any())

    def find(self, entries: list[str]) -> np.ndarray:
        """Index of every entry in the list, -1 where it is not in it."""
        out = np.full(len(entries), -1, np.int64)
        if not entries or not len(self.keys):
            return out
        wanted = np.fromiter(map(digest, entries), np.uint64, len(entries))
        at = np.searchsorted(self.keys, wanted)
        inside = np.minimum(at, len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[inside] == wanted):
            text, k = entries[i].encode(), int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == text:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The winning rule and the verdict for every URL."""
        entries, owner, length = [], [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            for h, p in self.shapes:
                if len(host) >= h and len(path) >= p and (len(host) == h or host[-h - 1] == "."):
                    entries.append(f"{RULE}{host[len(host) - h:]}{path[:p]}")
                    owner.append(row)
                    length.append((h + p, h))
        best: dict[int, tuple] = {}
        for n, k in zip(range(len(entries)), self.find(entries)):
            if k >= 0 and (owner[n] not in best or length[n] > best[owner[n]][0]):
                best[owner[n]] = (length[n], entries[n][1:], BLOCK if self.blocks[k] else ALLOW)
        rules = [best[r][1] if r in best else None for r in range(len(hosts))]
        verdicts = [best[r][2] if r in best else ALLOW for r in range(len(hosts))]
        if self.has_words:
            words, owner = [], []
            for row, host in enumerate(hosts):
                if row not in best and host:
                    found = [WORD + w for w in host.replace("-", ".").split(".")]
                    words += found
                    owner += [row] * len(found)
            for row, k in zip(owner, self.find(words)):
                if k >= 0:
                    verdicts[row] = BLOCK
        return rules, verdicts


def host_of(url: Column | str) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column | str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_LISTS: dict[str, DigestList] = {}


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], words: tuple[str, ...] = BLOCKED_WORDS, url: str = "url"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict`` to every row.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule wins; of
    two equally long ones that with the longer host. Without a rule, a host that contains one of ``words`` is
    blocked and all others are allowed. A null or empty URL, or one without ``://``, has an empty host and path
    and is allowed; repeated rows stay; columns named like the new ones are replaced.
    """
    name = ship(pages.sparkSession, build_list(rules, words), "urls")
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in new]
    parsed = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    schema = widened(parsed, rule="string", verdict="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LISTS:
            _LISTS[name] = DigestList(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = (batch.column(len(kept) + i).to_pylist() for i in range(2))
            rule, verdict = _LISTS[name].judge(hosts, paths)
            columns = [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return parsed.mapInArrow(run, schema)
