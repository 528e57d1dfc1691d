"""Which of many names occur in a text: a multi-pattern automaton over code points."""

from __future__ import annotations

from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.session import bounded

#: Names of an automaton, and texts that a task looks through at once.
NAMES, TEXTS = 20_000, 5_000


class Automaton:
    """Goto, failure and output tables of a set of names, as arrays; goto is looked up by state and code point."""

    def __init__(self, names: list[str]):
        self.goto: dict[int, int] = {}  # state << 21 | code point: a code point has 21 bits at most
        self.ends, children = array("l", [-1]), [[]]
        for k, name in enumerate(names):
            state = 0
            for c in map(ord, name):
                to = self.goto.get(state << 21 | c)
                if to is None:
                    to = self.goto[state << 21 | c] = len(children)
                    children[state].append((c, to))
                    children.append([])
                    self.ends.append(-1)
                state = to
            self.ends[state] = k
        n = len(children)
        #: where a state goes on when its name can't, and the next shorter name that ends there too
        self.fail, self.shorter, self.sizes = array("l", [0] * n), array("l", [0] * n), array("l", map(len, names))
        queue = deque(to for _, to in children[0])
        while queue:
            state = queue.popleft()
            for c, to in children[state]:
                back = self.fail[state]
                while back and back << 21 | c not in self.goto:
                    back = self.fail[back]
                self.fail[to] = back = self.goto.get(back << 21 | c, 0)
                self.shorter[to] = back if self.ends[back] >= 0 else self.shorter[back]
                queue.append(to)

    def find(self, text: str, word_start: bool = False) -> set[int]:
        """The names that occur in a text; with ``word_start`` only where no letter or digit stands before them."""
        found, state, goto = set(), 0, self.goto
        for i, c in enumerate(map(ord, text)):
            while state and state << 21 | c not in goto:
                state = self.fail[state]
            state = goto.get(state << 21 | c, 0)
            at = state if self.ends[state] >= 0 else self.shorter[state]
            while at:
                k = self.ends[at]
                begin = i + 1 - self.sizes[k]
                if not word_start or not begin or not text[begin - 1].isalnum():
                    found.add(k)
                at = self.shorter[at]
        return found


def occurrences(texts: DataFrame, names: DataFrame, keys: list[str], text: Column, name: Column, word_start: bool = False) -> DataFrame:
    """keys, query_id and name of every distinct name that occurs in a text of the same keys.

    texts has keys, query_id and the columns of ``text``, names has keys and those of ``name``. Texts stay where they
    are: at most NAMES names are sent to the tasks as an automaton; of more of them a filter of bits is sent,
    which the pieces of a text with a name's length are looked up in. What a task finds meets the names of its keys, letter by
    letter, so neither side is there more than once. Empty names and nulls occur nowhere.
    """
    k = [F.col(c) for c in keys]
    distinct = names.select(*k, name.alias("name")).where("name <> ''").distinct()
    asked = texts.select(*k, "query_id", text.alias("text")).where("text is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*k, "query_id").schema) + ", name string"
    spelt = distinct.select("name").distinct()
    few = [r.name for r in spelt.limit(NAMES + 1).collect()]
    pieces = None if len(few) <= NAMES else Pieces.of(spelt)

    def run(batches):
        machine = Automaton(few) if pieces is None else None
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            coded = batch.column("text").dictionary_encode()  # a text that is asked of many recordings is looked through once
            listed = coded.dictionary.to_pylist()
            hits = [[few[x] for x in sorted(machine.find(t, word_start))] for t in listed] if machine else pieces.find(listed, word_start)
            own = coded.indices.to_pylist()
            rows = pa.array([i for i, t in enumerate(own) for _ in hits[t]], pa.int64())
            yield batch.select([*keys, "query_id"]).take(rows).append_column("name", pa.array([x for t in own for x in hits[t]], pa.string()))

    return asked.mapInArrow(run, schema).join(bounded(distinct), [*keys, "name"], "left_semi").select(*keys, "query_id", "name")


class Pieces:
    """A filter of bits of very many names: by it the pieces of texts that may be one of them are found, of all lengths that names have."""

    #: Bits of a name, and of the filter at most; an odd number whose powers weigh the bytes of a piece, and its inverse.
    BITS, MOST = 16, 1 << 27
    BASE = 0x9E3779B97F4A7C15
    BACK = pow(BASE, -1, 1 << 64)
    BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256).astype(np.uint64)

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, lengths

    @classmethod
    def of(cls, names: DataFrame) -> Pieces:
        """The filter of distinct names (name), whose words of bits are made in the tasks."""
        n, lengths = names.agg(F.count("*"), F.collect_set(F.octet_length("name"))).first()
        size = min(cls.MOST, 1 << (n * cls.BITS - 1).bit_length())

        def words(batches):
            for batch in batches:
                data, ends = cls.joined(batch.column("name").to_pylist())
                at = np.concatenate(cls.places(cls.hashes(data, ends[:-1], np.diff(ends)), size))
                word, which = np.unique(at >> 6, return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, which, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits.view(np.int64))], ["word", "bits"])

        rows = names.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(max(size >> 6, 1), np.uint64)
        bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(bits, sorted(lengths))

    @staticmethod
    def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts, one after another, and where each begins and the last ends."""
        coded = [t.encode() for t in texts]
        return np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in coded], dtype=np.int64)])

    @classmethod
    def hashes(cls, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number of 64 bits for each piece of data, the same wherever it stands."""
        power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), x, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cls.BYTES[data] * power(cls.BASE)[:-1], dtype=np.uint64)])
        own = (sums[begin + size] - sums[begin]) * power(cls.BACK)[begin]
        own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return own ^ (own >> np.uint64(29))

    @staticmethod
    def places(own: np.ndarray, size: int) -> list[np.ndarray]:
        return [((own >> np.uint64(by)) & np.uint64(size - 1)).astype(np.int64) for by in (0, 18, 37)]

    def find(self, texts: list[str], word_start: bool) -> list[list[str]]:
        """Of each text the distinct pieces that may be names."""
        data, ends = self.joined(texts)
        found = [set() for _ in texts]
        whose = np.repeat(np.arange(len(texts)), np.diff(ends))
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # where a code point begins
        for length in self.lengths:
            at = starts[starts + length <= ends[whose[starts] + 1]]
            own = self.hashes(data, at, np.full(len(at), length)) if len(at) else np.zeros(0, np.uint64)
            there = np.ones(len(at), bool)
            for place in self.places(own, len(self.bits) << 6):
                there &= (self.bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
            for i in at[there].tolist():
                first, last = ends[whose[i]], ends[whose[i] + 1]
                if i + length < last and data[i + length] & 0xC0 == 0x80:
                    continue  # ends within a code point
                if not word_start or i == first or not data[first:i].tobytes().decode()[-1].isalnum():
                    found[whose[i]].add(data[i : i + length].tobytes().decode())
        return [sorted(x) for x in found]
