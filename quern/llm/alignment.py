"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. Read side by side, one of them is ahead by
some bytes that the other has yet to cover: the dangling suffix. The state is
which side leads and that suffix. The other side's next token either uses up a
part of it, or all of it, or runs past it and takes the lead. Where nothing is
left both sides end a token at one place: a group closes, and its last two
tokens are linked. A transition depends on the suffix and the token alone, so
each is worked out once a process and looked up from then on.

Two linked tokens end at the same byte of the same text: one's bytes are a
suffix of the other's. The pairs that any corpus can link are therefore among
the suffixes of the two vocabularies' tokens, some hundred thousand
(``linkable``), however many documents there are; the table of their counts is
small enough to be sent to every task.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import staged
from quern.llm.tokens import RANKS, VOCABULARY, encoder, place

PIECES = "piece_bpe_32k.model"
#: Transitions that a process remembers, some 100 bytes each; it then starts afresh.
MEMORY = 1 << 19
#: A pair of ids as one number: the first tokenizer's times this, plus the second's.
SHIFT = 1 << 32


def byte_level_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE vocabulary."""
    # Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    ids = dict(model["model"]["vocab"])
    made = [b""] * (max([*ids.values(), *(t["id"] for t in model.get("added_tokens", ()))]) + 1)
    for text, k in ids.items():
        made[k] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
    for t in model.get("added_tokens", ()):
        made[t["id"]] = t["content"].encode()
    return made


def piece_bytes(processor) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: byte pieces as their byte, U+2581 as a space."""
    pieces = (processor.id_to_piece(k) for k in range(processor.vocab_size()))
    return [bytes([int(p[3:5], 16)]) if processor.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]


class Transducer:
    """Groups of two token sequences over the same bytes.

    States are numbers: 0 has no suffix, even ones have the first side ahead,
    odd ones the second. ``first`` and ``second`` hold the bytes of the sides'
    ids.
    """

    def __init__(self, first: list[bytes], second: list[bytes], memory: int = MEMORY):
        self.first, self.second, self.memory = first, second, memory
        # Tokens of the same bytes have the same number: from no suffix, such a pair leads back to none.
        numbers = {x: k for k, x in enumerate(dict.fromkeys((*first, *second)))}
        self.number_a, self.number_b = ([numbers[x] for x in side] for side in (first, second))
        self._clear()

    def _clear(self) -> None:
        self.suffixes, self.numbers, self.steps, self.starts = {0: b""}, {}, {}, {}

    def _number(self, suffix: bytes, second_leads: int) -> int:
        if not suffix:
            return 0
        if (suffix, second_leads) not in self.numbers:
            n = 2 * len(self.suffixes) + second_leads
            self.numbers[suffix, second_leads], self.suffixes[n] = n, suffix
        return self.numbers[suffix, second_leads]

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that is behind (of the first where neither is); -1 where the bytes differ."""
        found = self.steps.get(state << 20 | token)
        if found is None:
            behind = 0 if state & 1 or not state else 1
            new, suffix = (self.second if behind else self.first)[token], self.suffixes[state]
            if suffix.startswith(new):
                found = self._number(suffix[len(new) :], state & 1)
            elif new.startswith(suffix):
                found = self._number(new[len(suffix) :], behind)
            else:
                found = -1
            self.steps[state << 20 | token] = found
        return found

    def inner(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """Places of the tokens of both sides that end no group; None if the bytes differ."""
        if len(self.steps) + len(self.starts) > self.memory:
            self._clear()
        steps, starts, number_a, number_b, inner_a, inner_b = self.steps, self.starts, self.number_a, self.number_b, [], []
        rest_a, rest_b, more_a, more_b = iter(a), iter(b), 0, 0
        for k, (x, y) in enumerate(zip(rest_a, rest_b)):
            if number_a[x] == number_b[y]:
                continue
            state = starts.get(x << 20 | y)
            if state is None:  # two transitions at once
                state = starts[x << 20 | y] = self.step(self.step(0, x), y)
            while state:
                if state < 0:
                    return None
                # A side that goes on within a group hadn't ended it.
                if state & 1:
                    inner_a.append(k + more_a)
                    token = next(rest_a, None)
                    more_a += 1
                else:
                    inner_b.append(k + more_b)
                    token = next(rest_b, None)
                    more_b += 1
                if token is None:  # one side ends before the other
                    return None
                after = steps.get(state << 20 | token)
                state = self.step(state, token) if after is None else after
        # Both sides have a last token in each group.
        return (inner_a, inner_b) if len(a) - more_a == len(b) - more_b else None


class Aligner:
    """Tokens of both tokenizers and their groups, for one text after another."""

    def __init__(self, vocabulary: str, ranks: str | None, pieces: str):
        import sentencepiece

        self.encode_a = encoder(vocabulary, ranks, True)
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=place(pieces))
        self.bytes_a, self.bytes_b = byte_level_bytes(place(vocabulary)), piece_bytes(self._pieces)
        self.transducer = Transducer(self.bytes_a, self.bytes_b)
        told = lambda n, end: [f"{k}{end}" for k in range(n)]
        self._a = told(len(self.bytes_a), ","), told(len(self.bytes_a), "|")
        self._b = told(len(self.bytes_b), ","), told(len(self.bytes_b), ";")

    def __call__(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """Ids of both sides and the places of those that end no group; None without tokens: for a null or empty text, or where the bytes aren't the text's."""
        if not text:
            return None
        whole = " " + text
        a, b = self.encode_a.ids(whole), self._pieces.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole.encode():
            return None
        inner = self.transducer.inner(a, b)
        return None if inner is None else (a, b, *inner)

    def told(self, a: list[int], b: list[int], inner_a: list[int], inner_b: list[int]) -> str:
        """The groups as a1,a2|b1;a3|b2,b3."""
        sides = []
        for ids, inner, (within, end) in ((a, inner_a, self._a), (b, inner_b, self._b)):
            parts = list(map(end.__getitem__, ids))
            for k in inner:
                parts[k] = within[ids[k]]
            sides.append("".join(parts)[:-1].split(end[0][-1]))
        return ";".join([f"{x}|{y}" for x, y in zip(*sides)])


def _last(ids: list[int], inner: list[int]) -> np.ndarray:
    """The ids that end a group."""
    last = np.ones(len(ids), bool)
    last[inner] = False
    return np.array(ids, np.int64)[last]


@lru_cache(maxsize=1)
def aligner(vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES) -> Aligner:
    """One a worker process."""
    return Aligner(vocabulary, ranks, pieces)


def linkable(first: list[bytes], second: list[bytes]) -> int:
    """How many pairs of ids can be linked at all: one's bytes are a suffix of the other's."""
    by_bytes = lambda side: {x: sum(1 for _ in g) for x, g in _grouped(side)}
    a, b = by_bytes(first), by_bytes(second)
    within = lambda long, short, own: sum(n * short.get(x[k:], 0) for x, n in long.items() for k in range(0 if own else 1, len(x)))
    return within(a, b, True) + within(b, a, False)


def _grouped(side: list[bytes]):
    from itertools import groupby

    return groupby(sorted(x for x in side if x))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, groups (a1,a2|b1;a3|b2,b3), pairs and times.

    The first tokenizer reads a space and the text, the second, which puts the
    space itself, the text; special tokens' strings are text. ``pairs`` are the
    different linked pairs of ids as numbers (``SHIFT``), ``times`` how often each
    is linked in the document.

    A null or empty text, and one whose tokens' bytes aren't a space and the
    text, has no tokens: zeros and an empty text. Ids may be null or repeated
    and repeated rows stay; a very long text is aligned whole in one task; an
    empty table gives no rows; other columns are left out, whatever their names.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        align = aligner(vocabulary, ranks, pieces)
        none = np.empty(0, np.int64)
        for batch in batches:
            sizes, told, pairs, times = [], [], [], []
            for text in batch.column(1):
                found = align(text.as_py())
                if found is None:
                    sizes.append((0, 0, 0))
                    told.append("")
                    pairs.append(none)
                    times.append(none)
                    continue
                a, b, inner_a, inner_b = found
                told.append(align.told(*found))
                links = _last(a, inner_a) * SHIFT + _last(b, inner_b)
                sizes.append((len(a), len(b), len(links)))
                pair, n = np.unique(links, return_counts=True)
                pairs.append(pair)
                times.append(n)
            n_a, n_b, n_groups = (pa.array(x, pa.int64()) for x in zip(*sizes)) if sizes else (pa.array([], pa.int64()),) * 3
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            listed = lambda parts, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *parts]).astype(kind)))
            columns = [batch.column(0), n_a, n_b, n_groups, pa.array(told, pa.string()), listed(pairs, np.int64), listed(times, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    long = F.lit(0).cast("long")
    shape = kept.select("doc_id", long.alias("n_a"), long.alias("n_b"), long.alias("n_groups"), F.lit("").alias("groups"), F.lit(None).cast("array<long>").alias("pairs"), F.lit(None).cast("array<int>").alias("times"))
    return kept.mapInArrow(run, shape.schema)


def _each(rows: DataFrame, *columns: str) -> DataFrame:
    """A row per pair of each document: pair and times."""
    return rows.select(*columns, F.explode_outer(F.arrays_zip("pairs", "times")).alias("l")).select(*columns, F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, count and best for every linked pair of ids: links of all documents, and whether no other pair of b has more.

    ``rows`` has pairs and times. Its rows are as few as the vocabularies'
    suffixes.
    """
    counts = _each(rows).where("pair is not null").groupBy("pair").agg(F.sum("times").alias("count"))
    counts = staged(counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(SHIFT - 1).cast("int").alias("b"), "count"), "pairs")
    most = counts.groupBy(F.col("b").alias("of")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("b") == F.col("of")).select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, as ``aligned`` takes documents.

    n_best are the links whose pair no other pair of the second tokenizer's id
    outnumbers in all documents, count_sum the sum of the links' counts. The
    digest of a document without tokens is empty.
    """
    found = aligned(docs, id_col, text_col, vocabulary, ranks, pieces)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = staged(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    # Bounded by the vocabularies (linkable), never by the documents.
    counts = F.broadcast(staged(pair_counts(rows).select(F.col("pair").alias("of"), "count", "best"), "counts"))
    keys = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    met = _each(rows, *keys).join(counts, F.col("pair") == F.col("of"), "left")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    # A document's rows are neighbours: the sums before the shuffle leave one row of each.
    sums = met.groupBy(*keys).agg(total(F.col("times"), "n_links"), total(F.when(F.col("best"), F.col("times")), "n_best"), total(F.col("times") * F.col("count"), "count_sum"))
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's groups of the two tokenizers' tokens, and how usual their links are in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return linked(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
