"""Encoding by a public byte-level BPE vocabulary with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. Its states are the token
read last (and the start). It is built by applying one gadget per merge (u, v) -> w, in order of rank:

* the arc v is taken out of state u, as u and v side by side are merged from now on;
* wherever the arc u leads on, w gets an arc beside it;
* state w starts with the arcs that state v has at this moment.

The second and third step are not written out, that would be billions of arcs: w keeps a pointer to u (for "beside
u") and to v (for "as v"), with its rank as the moment. Only removed arcs are stored. Whether state p has arc t follows
from the removed arcs between what p descends from and what t stands beside, and is kept once it has been looked
up, so encoding runs on a table of transitions. Every prefix of a word has exactly one accepted path, which a
single pass over the word finds.

A vocabulary file holds no merges but ranked tokens; the merge of a token is the path of its bytes in the automaton
built so far.
"""

from __future__ import annotations

import base64
import os
import threading
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
#: How a text is parted into words before merging; a fixed value that belongs to the vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START = -1
#: States and arcs share a key of 20 bits each.
MOST_TOKENS = 2**20
#: Words whose encoding a worker remembers, and transitions; both are emptied when full.
WORDS_KEPT = 300_000
ARCS_KEPT = 2_000_000
LONGEST_KEPT = 64
#: Letters of text that are encoded before their ids are handed on.
HANDED_ON = 4_000_000


def read_ranks(name: str, folder: str = TOKENIZER_DIR) -> list[bytes]:
    """The tokens of a `.tiktoken` vocabulary in order of rank; a token's rank is its id."""
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"the ranks of {name} are not dense")
    return [token for _, token in ranked]


class Automaton:
    """The tokenization automaton of ranked tokens; `compiled` restores one without compiling again."""

    def __init__(self, tokens: list[bytes], compiled: tuple[array, array] | None = None) -> None:
        if len(tokens) > MOST_TOKENS:
            raise ValueError(f"the automaton holds {MOST_TOKENS} tokens at most")
        self.tokens = tokens
        self.beside = array("i", [-1]) * len(tokens)  # u of the merge that made the token
        self.like = array("i", [-1]) * len(tokens)  # v of it
        self.removed: dict[int, int] = {}  # (state << 20 | arc) -> rank of the merge that removed it
        self.allowed: dict[int, bool] = {}
        self.nodes: dict[int, int] = {}  # byte trie of the tokens: (node << 8 | byte) -> node
        self.node_token = array("i", [-1])
        self.words: dict[str, tuple[int, ...]] = {}
        if compiled is None:
            self._compile()
        else:
            self.beside, self.like = compiled
            for token, data in enumerate(tokens):
                self._add_to_trie(token, data)
                if self.beside[token] >= 0:
                    self.removed[self.beside[token] << 20 | self.like[token]] = token

    def compiled(self) -> tuple[array, array]:
        return self.beside, self.like

    def _compile(self) -> None:
        for token, data in enumerate(self.tokens):
            if len(data) > 1:
                path = self.path(data)
                if len(path) != 2:
                    raise ValueError(f"token {token} is no merge of two earlier ones")
                self._merge_gadget(token, *path)
            self._add_to_trie(token, data)
        self.allowed.clear()

    def _merge_gadget(self, token: int, u: int, v: int) -> None:
        self.removed[u << 20 | v] = token
        self.beside[token], self.like[token] = u, v
        # of the arcs looked up so far, those change whose state descends from u and whose token stands beside v
        self.allowed.clear()

    def _add_to_trie(self, token: int, data: bytes) -> None:
        node = 0
        for byte in data:
            after = self.nodes.get(node << 8 | byte)
            if after is None:
                after = self.nodes[node << 8 | byte] = len(self.node_token)
                self.node_token.append(-1)
            node = after
        self.node_token[node] = token

    def has_arc(self, state: int, token: int) -> bool:
        """Whether `token` may follow `state`."""
        if state < 0:
            return True
        key = state << 20 | token
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) >= ARCS_KEPT:
                self.allowed.clear()
            known = self.allowed[key] = self._derive_arc(state, token)
        return known

    def _derive_arc(self, state: int, token: int) -> bool:
        removed, like, beside = self.removed, self.like, self.beside
        born_state, p = 1 << 30, state
        while p >= 0:
            born_token, t = 1 << 30, token
            while t >= 0:
                rank = removed.get(p << 20 | t)
                # a state keeps what its model had lost before the state was born; an arc is not added beside one
                # that was lost by then
                if rank is not None and rank < born_state and rank <= born_token:
                    return False
                born_token, t = t, beside[t]
            born_state, p = p, like[p]
        return True

    def path(self, data: bytes) -> list[int]:
        """The accepted token sequence of some bytes; time grows as their number times the longest token."""
        n, nodes, node_token, has_arc = len(data), self.nodes, self.node_token, self.has_arc
        last = [START] * (n + 1)
        for at in range(n):
            state, node = last[at] if at else START, 0
            for end in range(at, n):
                node = nodes.get(node << 8 | data[end])
                if node is None:
                    break
                token = node_token[node]
                if token >= 0 and last[end + 1] < 0 and has_arc(state, token):
                    last[end + 1] = token
        found, at = [], n
        while at > 0:
            found.append(last[at])
            at -= len(self.tokens[last[at]])
        return found[::-1]

    def encode_word(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.path(word.encode("utf-8")))
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or an empty one. Strings of special tokens are ordinary text."""
        if not text:
            return []
        ids: list[int] = []
        known, encode_word = self.words, self.encode_word
        for word in words_of(text):
            ids += known.get(word) or encode_word(word)
        return ids

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, encode_word = self.words, self.encode_word
        return sum(len(known.get(word) or encode_word(word)) for word in words_of(text))

    def decode(self, ids: Iterable[int]) -> str:
        """Emit the labels of the arcs that the ids name, one after the other. Whether an arc may follow the one before makes no
        difference to its label, so a sequence that the automaton does not accept (see `accepts`) is spelled out as well,
        as any tokenizer does."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", errors="replace")

    def accepts(self, ids: Iterable[int]) -> bool:
        state = START
        for token in ids:
            if not self.has_arc(state, token):
                return False
            state = token
        return True


_word = regex.compile(WORD_PATTERN)


def words_of(text: str) -> Iterable[str]:
    """The words of a text, all at once unless there would be very many."""
    return _word.findall(text) if len(text) < HANDED_ON else (found.group() for found in _word.finditer(text))


_loaded: dict[int, Automaton] = {}
_lock = threading.Lock()


def shared_automaton(spark: SparkSession, name: str, folder: str = TOKENIZER_DIR) -> Broadcast:
    """The compiled automaton of a vocabulary for all workers: the tokens and two integers for each, about 1.5 MB for
    50,000 tokens whatever the corpus is."""
    return spark.sparkContext.broadcast(_compiled(name, folder, os.stat(f"{folder}/{name}.tiktoken").st_mtime_ns))


@lru_cache(maxsize=8)
def _compiled(name: str, folder: str, changed: int) -> tuple[list[bytes], tuple[array, array]]:
    """Tokens and compiled automaton of a vocabulary file as of its last change; compiled once by a driver."""
    tokens = read_ranks(name, folder)
    return tokens, Automaton(tokens).compiled()


def worker_automaton(shared: Broadcast) -> Automaton:
    """The worker process's automaton, which keeps its tables from one task to the next."""
    with _lock:
        key = hash(b" ".join(shared.value[0]))
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Automaton(*shared.value)
        return _loaded[key]


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with few enough letters to hold, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + HANDED_ON, side="right")))
        part = batch.slice(at, end - at)
        yield part, part.column(text).to_pylist()
        at = end


def _encode(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    automaton = worker_automaton(shared)
    for batch in batches:
        for part, texts in _slices(batch, "text"):
            flat, offsets = array("i"), np.zeros(len(texts) + 1, np.int32)
            for k, text in enumerate(texts):
                flat.extend(automaton.encode(text))
                offsets[k + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])


def _count(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    automaton = worker_automaton(shared)
    for batch in batches:
        for part, texts in _slices(batch, "text"):
            counts = pa.array([automaton.count(t) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), counts], names=["id", "n_tokens"])


def encode_texts(df: DataFrame, doc_id: str, text: str, tokenizer: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids array<int>): the whole text of every row as ids of the vocabulary, without special tokens.

    A null and an empty text give an empty array; a blank one is encoded like any other. A row with a null id keeps it;
    repeated rows are encoded each. An empty table gives no rows; further columns are ignored. No shuffle.
    """
    shared = shared_automaton(df.sparkSession, tokenizer, folder)
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _encode(batches, shared), schema).withColumnRenamed("id", doc_id)


def count_tokens(df: DataFrame, doc_id: str, text: str, tokenizer: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, n_tokens): number of ids that `encode_texts` gives, 0 for a null and an empty text."""
    shared = shared_automaton(df.sparkSession, tokenizer, folder)
    schema = T.StructType([T.StructField("id", df.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType())])
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _count(batches, shared), schema).withColumnRenamed("id", doc_id)
