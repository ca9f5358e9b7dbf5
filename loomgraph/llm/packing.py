"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Documents stay in the order of their partition and are laid end to end; window cuts may fall at document ends, at
sentence ends, and inside long sentences. With ``f(j)`` the least cost of all windows up to cut ``j``,

    f(j) = min over i with p(j) - p(i) <= L of  f(i) + p(i)  +  L - p(j) + penalty(j),

where ``L - (p(j) - p(i))`` is the padding and the penalty says what truncating a document there costs, in tokens.
The minimum over a sliding range of ``f(i) + p(i)`` comes from a monotone queue, so a stream of ``n`` possible
cuts takes ``n`` steps. Streams are worked off in segments; the last window of a segment is opened again in the next.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from loomgraph.llm.frames import map_rows

LENGTH = 2048
SENTENCE_PENALTY = 8
INNER_PENALTY = 32
# Inside a sentence, every so many tokens a cut is possible.
INNER_STEP = 32
SEGMENT = 1 << 20
END_ID = 1

# The split pattern of the rank file's vocabulary, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Up to here both libraries have the same classes of characters, whatever their Unicode version.
_SETTLED = re.compile("[^\x00-ɏ]")


class Encoder:
    """Ids of the tokenizer file; ``ranks`` is the same vocabulary as ranks, which a faster library reads.

    The ids are equal (tested); special tokens and characters beyond Latin go to the tokenizer itself."""

    def __init__(self, vocabulary: str, ranks: str | None, end_id: int):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], np.uint32)
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        size = self.tokenizer.get_vocab_size()
        texts = self.tokenizer.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
        self.sentence_end = np.array([t.endswith((".", "!", "?", ".\"", ".)")) or "\n" in t for t in texts] + [False])

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast and not _SETTLED.search(text) and not any(s in text for s in self.special):
            found = np.array(self.fast.encode_ordinary(text), np.uint32)
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([found, self.end])


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, ranks: str | None, end_id: int) -> Encoder:
    return Encoder(vocabulary, ranks, end_id)


def possible_cuts(ids: np.ndarray, sentence_end: np.ndarray, step: int = INNER_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places of one document after which a window may end, and their kind: 0 its end, 1 a sentence's, 2 neither."""
    n = len(ids)
    ends = np.flatnonzero(sentence_end[np.minimum(ids[:-1], len(sentence_end) - 1)]) + 1
    fixed = np.append(ends[ends < n], n)
    gaps = np.diff(fixed, prepend=0)
    fill = (gaps - 1) // step
    if fill.any():
        wide = np.flatnonzero(fill)
        counts = fill[wide]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        nth = np.arange(int(counts.sum())) - np.repeat(starts, counts) + 1
        inner = np.repeat(fixed[wide] - gaps[wide], counts) + nth * step
        places = np.concatenate([fixed, inner])
        kinds = np.concatenate([np.where(fixed == n, 0, 1), np.full(len(inner), 2)])
        order = np.argsort(places, kind="stable")
        return places[order], kinds[order]
    return fixed, np.where(fixed == n, 0, 1)


def best_windows(places: list[int], penalties: list[int], length: int) -> list[int]:
    """The cheapest chain of window ends from 0 to the last of ``places`` (ascending, gaps of at most ``length``)."""
    queue = deque([(0, 0, -1)])  # f(i) + p(i) ascending, with p(i) and i
    before = []
    for j, (p, penalty) in enumerate(zip(places, penalties, strict=True)):
        while queue[0][1] < p - length:
            queue.popleft()
        least, _, i = queue[0]
        before.append(i)
        key = least + length + penalty  # f(j) + p(j)
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    ends, j = [], len(places) - 1
    while j >= 0:
        ends.append(places[j])
        j = before[j]
    return ends[::-1]


class _Stream:
    """Documents laid end to end, cut into windows segment by segment."""

    def __init__(self, first_id: int, length: int, penalties: tuple[int, int, int], step: int, with_ids: bool):
        self.next_id, self.length, self.penalties, self.step, self.with_ids = first_id, length, np.array(penalties), step, with_ids
        self.docs: list[tuple[int | None, int, np.ndarray, int]] = []  # id, ids before, ids, ids of the whole document
        self.places: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.places.append(cuts[0] + self.size)
        self.kinds.append(cuts[1])
        self.size += len(ids)

    def windows(self, final: bool) -> Iterator[tuple]:
        if not self.size:
            return
        places, kinds = np.concatenate(self.places), np.concatenate(self.kinds)
        ends = best_windows(places.tolist(), self.penalties[kinds].tolist(), self.length)
        if not final:
            ends.pop()
        docs, self.docs = deque(self.docs), []
        at = 0
        for end in ends:
            offset = 0
            while at < end:
                doc_id, start, ids, total = docs.popleft()
                n = min(len(ids), end - at)
                piece = ids[:n]
                row = doc_id, start, n, zlib.crc32(piece.astype("<u4").tobytes()), total, self.next_id, offset
                yield (*row, piece.tolist()) if self.with_ids else row
                if n < len(ids):
                    docs.appendleft((doc_id, start + n, ids[n:], total))
                at += n
                offset += n
            self.next_id += 1
        left = places > at
        self.docs, self.places, self.kinds = list(docs), [places[left] - at], [kinds[left]]
        self.size -= at


def _pack(rows: Iterator[tuple], vocabulary, ranks, length, end_id, penalties, step, segment, with_ids) -> Iterator[tuple]:
    encoder = _encoder(vocabulary, ranks, end_id)
    stream = _Stream(TaskContext.get().partitionId() << 40, length, penalties, step, with_ids)
    for doc_id, text in rows:
        ids = encoder.ids(text)
        stream.add(doc_id, ids, possible_cuts(ids, encoder.sentence_end, step))
        if stream.size >= segment:
            yield from stream.windows(final=False)
    yield from stream.windows(final=True)


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    sentence_penalty: int = SENTENCE_PENALTY,
    inner_penalty: int = INNER_PENALTY,
    step: int = INNER_STEP,
    segment: int = SEGMENT,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` on request).

    Each document is its token ids and ``end_id``; each id is in exactly one piece; the pieces of a sequence
    lie gapless from offset 0 and hold at most ``length`` ids. Null and empty texts are the end id alone; repeated rows
    and null ids are packed like any other; an empty table gives no rows; columns other than ``doc_id``
    and ``text`` are ignored. The order is that of the rows in each partition, and sequence ids carry the
    partition's number, so nothing is shuffled and partitions do not wait for each other; only the last
    sequence of a partition is shorter for want of documents."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    penalties = (0, sentence_penalty, inner_penalty)

    def make(rows):
        return _pack(rows, vocabulary, ranks, length, end_id, penalties, min(step, length), segment, with_ids)

    return map_rows(docs.select("doc_id", "text"), make, schema + (", ids array<int>" if with_ids else ""))
