"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The text is read left to right. One Aho-Corasick pass gives the longest piece that starts at every position.
A piece may follow the one before only if the two are *compatible*: merging the characters of both anew, in
the order of the model's scores, must give exactly these two pieces again. Only merges across the border can
prevent that, so it is enough to replay both pieces' merges that touch the border. If no prefix piece of the longest
match fits, the position is marked as failed in a bit field and the last piece is taken back. A sequence whose
neighbours are all compatible is the model's own result.

Spaces only open pieces, and characters outside the model's alphabet never merge, so a text falls apart into
words that are encoded on their own; a bounded cache keeps the recent ones.
"""

from __future__ import annotations

import gc
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, widened

SPACE = "▁"
CACHED_WORDS = 300_000
CACHED_PAIRS = 250_000
LONGEST_CACHED = 64
IDLE = 10.0  # seconds without a task after which a worker drops its encoder


class MergeEncoder:
    """Encoder for the pieces of one merge-type model given as bytes."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(lib.get_piece_size()):
            if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[lib.id_to_piece(i)] = i
                self.rank[lib.id_to_piece(i)] = -lib.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or lib.normalize("  Aé ") != SPACE * 3 + "Aé" + SPACE:
            raise ValueError("the model must keep white space and use the space mark only in front of pieces")
        # What every id stands for in a text: bytes, one after the other.
        texts = [self._text_of(i) for i in range(lib.get_piece_size())]
        self.text_sizes = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.has_bytes = lib.is_byte(self.bytes_ids[0])
        self.unknown = lib.unk_id()
        spaces = [p for p in self.ids if p.strip(SPACE) == ""]
        self.longest_run = max(map(len, spaces), default=1)
        # Pieces to be matched: every piece with at most one leading space mark, and every single character.
        self.alphabet = set("".join(self.ids)) | {SPACE}
        texts = [p for p in self.ids if p.strip(SPACE) or p == SPACE]
        texts += sorted(self.alphabet - set(texts))
        self.pieces = texts
        self.automaton = ahocorasick.Automaton()
        for n, piece in enumerate(texts):
            self.automaton.add_word(piece, n)
        self.automaton.make_automaton()
        self.number = {p: n for n, p in enumerate(texts)}
        self.size = [len(p) for p in texts]
        # Characters that stand side by side in some piece; elsewhere no merge crosses.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.most = max(self.size)
        # The longest piece that starts each path of the automaton.
        self.at_path = {}
        for piece in sorted(texts, key=len):
            for end in range(1, len(piece) + 1):
                path = piece[:end]
                if path not in self.at_path or end == len(piece):
                    self.at_path[path] = self.number.get(path, self.at_path.get(path[:-1], -1))
        # The next shorter piece that starts in the same way, or -1.
        self.shorter = [self._shorter(p) for p in texts]
        # Rank of the merge of two pieces.
        self.joins = {}
        for piece, rank in self.rank.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in self.number and piece[cut:] in self.number:
                    self.joins[self.number[piece[:cut]] << 32 | self.number[piece[cut:]]] = rank
        # What a matched piece stands for in the result.
        self.packed = [_pack([self.ids[p]] if p in self.ids else self.foreign(p)) for p in texts]
        self.trees: dict[str, tuple[str, str] | None] = {}
        self.borders: tuple[list, list] = ([None] * len(texts), [None] * len(texts))
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, bytes] = {}
        self.opening = _Words(self, SPACE)
        self.inner = _Words(self, "")

    def _text_of(self, i: int) -> bytes:
        lib = self.library
        if lib.is_byte(i):
            return bytes([int(lib.id_to_piece(i)[1:-1], 16)])
        if lib.is_control(i):
            return b""
        return lib.decode([0, i])[len(lib.decode([0])) :].encode() if not lib.is_unknown(i) else lib.decode([i]).encode()

    def _shorter(self, piece: str) -> int:
        for end in range(len(piece) - 1, 0, -1):
            if piece[:end] in self.number:
                return self.number[piece[:end]]
        return -1

    def merged(self, text: str) -> list[str]:
        """Merge characters by score, the leftmost first among equals. For a few characters only."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _tree(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of ``piece`` joins; None if merging does not lead to the piece."""
        if piece not in self.trees:
            parts = list(piece)
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best == np.inf:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = len(parts) == 2 and piece in self.rank
            if whole and any(len(p) > 1 and self.rank[p] >= self.rank[piece] for p in parts):
                raise ValueError("a piece of the model ranks before its own parts")
            self.trees[piece] = (parts[0], parts[1]) if whole else None
        return self.trees[piece]

    def _border(self, number: int, side: int) -> tuple[list[str], list[float]] | None:
        """Pieces that touch the right (``side`` 1) or left (0) end while ``number`` is merged, from the single
        character on, and the rank at which each is used up. None if the piece is never the result of merging."""
        found = self.borders[side][number]
        if found is None:
            piece = self.pieces[number]
            chain_, until = [piece], [np.inf]
            while len(chain_[-1]) > 1:
                tree = self._tree(chain_[-1])
                if tree is None:
                    chain_ = []
                    break
                until.append(self.rank[chain_[-1]])
                chain_.append(tree[side])
            numbers = [self.number[p] for p in reversed(chain_)]
            found = self.borders[side][number] = (numbers, until[::-1])
        return found if found[0] else None

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._remerge(left, right) if left >= 0 else self._border(right, 1) is not None
        return known

    def _remerge(self, left: int, right: int) -> bool:
        """Replay the merges on both sides of the border; a merge across it comes first if its rank is lower than
        that of the left piece's next merge and not higher than that of the right one's (the leftmost wins)."""
        a, b = self._border(left, 1), self._border(right, 0)
        if a is None or b is None:
            return False
        (lefts, left_until), (rights, right_until) = a, b
        i = j = 0
        joins = self.joins.get
        while True:
            across = joins(lefts[i] << 32 | rights[j])
            if across is not None and across < left_until[i] and across <= right_until[j]:
                return False
            if left_until[i] <= right_until[j]:
                if left_until[i] == np.inf:
                    return True
                i += 1
            else:
                j += 1

    def split(self, word: str) -> list[int]:
        """Numbers of the pieces of a word over the alphabet, by backtracking."""
        length, most = len(word), self.most
        size, shorter, known = self.size, self.shorter, self.pairs.get
        longest, at_path = self.automaton.longest_prefix, self.at_path
        failed = 0  # bit field of positions from which the rest cannot be encoded
        out: list[int] = []
        at, last = 0, -1
        rest = word[:most]
        piece = at_path[rest[: longest(rest)]]
        while True:
            while piece >= 0:
                end = at + size[piece]
                if not (failed and failed >> end & 1):
                    fits = known(last << 32 | piece)
                    if fits is None:
                        fits = self._compatible(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == length:
                    return out
                at, last = end, piece
                rest = word[at : at + most]
                piece = at_path[rest[: longest(rest)]]
            else:
                failed |= 1 << at
                piece = shorter[last]
                at -= size[out.pop()]
                last = out[-1] if out else -1

    def foreign(self, char: str) -> list[int]:
        """A character without a piece: its bytes, or the unknown id."""
        return [self.bytes_ids[b] for b in char.encode()] if self.has_bytes else [self.unknown]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word over the alphabet, as the bytes of 32-bit numbers."""
        return b"".join([self.packed[n] for n in self.split(word)])

    def cuts(self, word: str) -> list[str]:
        """The word in stretches that no merge can join."""
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)])] if at else [word]

    def spaces(self, count: int) -> bytes:
        """Ids of a run of space marks on its own. These pieces rank last, the leftmost pair first."""
        out = b""
        full = SPACE * self.longest_run
        if count >= 2 * self.longest_run and self.merged(full * 2) == [full, full]:
            whole = count // self.longest_run - 1
            out, count = _pack([self.ids[full]] * whole), count - whole * self.longest_run
        if count not in self.runs:
            parts = self.merged(SPACE * count)
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[count] = _pack([i for p in parts for i in ([self.ids[p]] if p in self.ids else self.foreign(p))])
        return out + self.runs[count]

    def _with_runs(self, words: list[str], out: list) -> None:
        """Words after the first of a stretch; empty ones are further space marks before the next word."""
        bare = _pack([self.ids[SPACE]]) if SPACE in self.ids else None
        run = 0
        for word in words:
            if not word:
                run += 1
                continue
            ids = self.opening[word]
            if run:
                if ids[:4] == bare:
                    run, ids = run + 1, ids[4:]
                out.append(self.spaces(run))
                run = 0
            out.append(ids)
        if run:
            out.append(self.spaces(run))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(SPACE, " ")
        out: list = []
        outside = set(text) - self.alphabet - {" "}
        stretches = re.split("([" + re.escape("".join(sorted(outside))) + "])", text) if outside else [text]
        for n, stretch in enumerate(stretches):
            if n % 2:
                out.append(_pack(self.foreign(stretch)))
                continue
            words = stretch.split(" ")
            if n:
                if words[0]:
                    out.append(self.inner[words[0]])
                words = words[1:]
            if "" in words:
                self._with_runs(words, out)
            else:
                out.extend(map(self.opening.__getitem__, words))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for, as the library gives it."""
        if not len(ids):
            return ""
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.text_starts[ids] - (ends - sizes), sizes)
        raw = self.text_bytes[where].tobytes()
        try:
            return (raw[1:] if raw[:1] == b" " else raw).decode()
        except UnicodeDecodeError:  # ids that no text gives
            return self.library.decode(ids.tolist())


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class _Words(dict):
    """Ids of words with a prefix; keeps short words, and drops the older half when full."""

    def __init__(self, encoder: MergeEncoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, word: str) -> bytes:
        first, *more = self.encoder.cuts(self.prefix + word)
        if more:
            known = self.encoder.inner
            head = self[first[len(self.prefix) :]] if len(first) > len(self.prefix) else self.encoder.word_ids(first)
            ids = b"".join([head, *[known[x] if x in known else known.__missing__(x) for x in more]])
        else:
            ids = self.encoder.word_ids(first)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                for old in list(islice(self, CACHED_WORDS // 2)):
                    del self[old]
            self[word] = ids
        return ids


_ENCODERS: dict[bytes, MergeEncoder] = {}


_waiting: threading.Timer | None = None


def encoder_for(model: bytes) -> MergeEncoder:
    """One encoder per worker process and model."""
    if model not in _ENCODERS:
        _ENCODERS[model] = MergeEncoder(model)
    return _ENCODERS[model]


def _forget() -> None:
    _ENCODERS.clear()
    gc.collect()
    give_back()


@contextmanager
def lent_encoder(model: bytes) -> Iterator[MergeEncoder]:
    """The worker's encoder for one task. It stays for the tasks that follow and goes when none comes for ``IDLE``
    seconds, since the worker process lives on and its memory is wanted by other work then."""
    global _waiting
    if _waiting:
        _waiting.cancel()
    try:
        yield encoder_for(model)
    finally:
        _waiting = threading.Timer(IDLE, _forget)
        _waiting.daemon = True
        _waiting.start()


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (the text those ids stand for) to every row.

    The model (below a megabyte) travels with the tasks. No begin or end ids, no sampling. A null or empty text
    gives no ids and an empty decoded text; repeated rows stay; columns named like the new ones are replaced.
    Rows are independent of each other, so nothing is shuffled and a long text costs only its own length.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    inner = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))
    fields = widened(inner.drop("_text"), **{ids: "array<int>", decoded: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker process lives on, and its later tasks find the words of this one.
        with lent_encoder(shared.value) as encoder:
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    rest = batch.slice(start, 500)
                    found = [encoder.encode(t) for t in rest.column(len(kept)).to_pylist()]
                    sizes = np.cumsum([0, *map(len, found)])
                    values = pa.array(np.concatenate(found), pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
                    back = pa.array([encoder.decode(x) for x in found], pa.string())
                    columns = [rest.column(i) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*columns, lists, back], names=[*kept, ids, decoded])

    return inner.mapInArrow(run, fields)
