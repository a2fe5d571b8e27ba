"""Cost-balanced packing of tokenised documents into sequences (operator 8).

Each task reads its documents once, tokenises them and packs them in windows of a bounded
number of tokens, so nothing is shuffled and no list of documents passes one place. In a
window, documents longer than a sequence give full sequences; what remains is placed in
descending length, each on the sequence of lowest estimated attention cost
(`linear * n + quadratic * n^2`, summed over its pieces) that still has room. Pieces that fit
nowhere are cut over the remaining room. The last tokens of a window go to sequences whose
lengths are powers of two, so there is no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from starpipe.llm.common import byte_slices, python_tasks

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
ARROW = pa.schema([(n, pa.int64()) for n in
                   ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
END_ID = 1
LONG_RUN = 50_000


@dataclass(frozen=True)
class Packing:
    """`capacity` is a power of two; `window` bounds the tokens a task holds at once."""

    capacity: int = 2048
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    window: int = 1 << 20

    def cost(self, n):
        return self.linear * n + self.quadratic * n * n


@cache
def tokenizer(vocabulary_path: str | None):
    """The public byte-level vocabulary with its added tokens, as the library reads it."""
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"))


@cache
def fast_tokenizer(vocabulary_path: str | None):
    """The same vocabulary in the faster library; its added tokens are found in texts as well.

    Names of tokens spell bytes by printable characters: bytes that are printable in Latin-1 stand
    for themselves, the others are numbered from 256 on.
    """
    import public_tokenizers
    import tiktoken

    spelt = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spelt |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in spelt)}
    known = tokenizer(vocabulary_path)
    special = {t.content: i for i, t in known.get_added_tokens_decoder().items()}
    ranks = {bytes(spelt[c] for c in name): i for name, i in known.get_vocab(with_added_tokens=False).items() if name not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def has_long_run(text: str) -> bool:
    """Whether white space runs on for LONG_RUN characters, in one look at the text."""
    return len(text) >= LONG_RUN and max(map(len, re.findall(r"\s+", text)), default=0) >= LONG_RUN


def token_ids(text: str | None, vocabulary_path: str | None = None) -> np.ndarray:
    """Ids of a text and the end id.

    Both libraries give the same ids. The faster one recurses over a run of white space and cannot
    take a very long one, so the other takes texts that hold one.
    """
    text = text or ""
    if has_long_run(text):
        ids = tokenizer(vocabulary_path).encode(text, add_special_tokens=False).ids
    else:
        ids = fast_tokenizer(vocabulary_path).encode(text, allowed_special="all", disallowed_special=())
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def capacities(total: int, full: int) -> list[int]:
    """Sequence lengths that hold exactly `total` tokens: full ones, then powers of two."""
    rest = total % full
    return [full] * (total // full) + [1 << b for b in reversed(range(full.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], plan: Packing) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents given by their lengths."""
    pieces, items, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % plan.capacity, plan.capacity):
            pieces.append((d, start, plan.capacity, sequence, 0))
            sequence += 1
        if n % plan.capacity:
            items.append((n % plan.capacity, d, n - n % plan.capacity))
    if not items:
        return pieces
    room = np.array(capacities(sum(i[0] for i in items), plan.capacity), dtype=np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    open_cost = np.empty(len(room))

    def place(k, n, d, start):
        pieces.append((d, start, n, sequence + int(k), int(used[k])))
        used[k] += n
        room[k] -= n
        cost[k] += plan.cost(n)

    left = []
    for n, d, start in sorted(items, key=lambda i: (-i[0], i[1])):
        np.copyto(open_cost, cost)
        open_cost[room < n] = np.inf
        k = int(open_cost.argmin())
        if room[k] >= n:
            place(k, n, d, start)
        else:
            left.append((n, d, start))
    gaps = [int(k) for k in np.argsort(cost, kind="stable") if room[k]]
    for n, d, start in left:
        while n:
            k = gaps[0]
            part = min(n, int(room[k]))
            place(k, part, d, start)
            n, start = n - part, start + part
            if not room[k]:
                gaps.pop(0)
    return pieces


def _packer(plan: Packing, vocabulary_path: str | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches):
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        made = held = 0
        docs: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal made, held, docs
            pieces = assign([len(ids) for _, ids in docs], plan)
            rows = [(docs[d][0], start, n, zlib.crc32(docs[d][1][start:start + n].tobytes()),
                     len(docs[d][1]), base + made + k, offset) for d, start, n, k, offset in pieces]
            made += 1 + max(p[3] for p in pieces)
            docs, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=ARROW)

        for batch in byte_slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = token_ids(text, vocabulary_path)
                docs.append((doc_id, ids))
                held += len(ids)
                if held >= plan.window:
                    yield flush()
        if docs:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, plan: Packing = Packing(), vocabulary_path: str | None = None) -> DataFrame:
    """One row per piece of each row of `docs` (doc_id, text; other columns are not read).

    A null text is empty, an empty text is the end id alone, repeated rows are packed each for
    itself, a null doc_id stays null, no documents give no rows. `vocabulary_path` is a file of the
    vocabulary that every executor can open; unset, the installed public one.
    """
    python_tasks(docs.sparkSession)
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return narrow.mapInArrow(_packer(plan, vocabulary_path), SCHEMA)
