"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The frequent words of all documents, counted whole (which words they are affects speed only),
are compiled with their ids into an automaton whose equal suffixes are shared. Arcs carry outputs
that sum to the word's number, which finds its ids. Tasks memory-map the compiled bytes. Words outside it are merged exactly by rank.

Null and empty texts give no ids. Ties in rank cannot occur (ranks are ids). Repeated rows give
one result row each; an empty table gives an empty result and an empty lexicon.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_map, table

VOCABULARY = "byte_bpe_50k.json"
LEXICON_WORDS, MEMO_WORDS = 50_000, 500_000
#: Letters, numbers and white space up to U+024F; other texts are split by the tokenizer's own splitter.
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND = re.compile("[^\x00-ɏ]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Vocabulary:
    """Byte strings of the ids, ranks, special strings and the splitter of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {w: i for w, i in data["model"]["vocab"].items() if w not in self.special}
        self.rank = {bytes(char[c] for c in w): i for w, i in vocab.items()}
        self.words = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for w, i in self.rank.items():
            self.words[i] = w
        for w, i in self.special.items():
            self.words[i] = w.encode()
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokenizer = Tokenizer.from_file(path)

    def split(self, text: str) -> list[str]:
        if text.isascii() or not BEYOND.search(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Words of ``text``; a special string is a piece of its own."""
        if self.marks is None or not any(m in text for m in self.special):
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            out += [part] if k % 2 else self.split(part) if part else []
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: repeatedly join the pair of least rank, leftmost first."""
        rank = self.rank
        if word in rank and len(word) == 1:
            return [rank[word]]
        if len(word) > 256:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        none = 1 << 40
        pairs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return [rank[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap and links, so that a very long word stays near linear."""
        import heapq

        rank, n = self.rank, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[word[i : i + 2]], i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in rank]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[a] + part[b]))
        return [rank[p] for p in part if p is not None]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """Minimal acyclic transducer over byte strings; ``numbers`` looks up many words at once."""

    def __init__(self, arcs, targets, outputs, final, starts, ids) -> None:
        self.arcs, self.targets, self.outputs, self.final, self.starts, self.ids = arcs, targets, outputs, final, starts, ids

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Add the words in order; a state is registered, and shared, once nothing can follow in it."""
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, {}]]

        def freeze(upto: int, last: bytes) -> None:
            while len(path) > upto + 1:
                done, arcs = path.pop()
                shape = (done, tuple(arcs.items()))
                if shape not in register:
                    register[shape] = len(frozen)
                    frozen.append(shape)
                path[-1][1][last[len(path) - 1]] = register[shape]

        last, order = b"", sorted(words)
        for word in order:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            freeze(shared, last)
            path.extend([False, {}] for _ in word[shared:])
            path[-1][0], last = True, word
        freeze(0, last)
        frozen.append((path[0][0], tuple(path[0][1].items())))
        ways = [0] * len(frozen)
        arcs, targets, outputs = [], [], []
        for s, (done, out) in enumerate(frozen):
            total = int(done)
            for byte, t in out:
                arcs.append(s * 256 + byte), targets.append(t), outputs.append(total)
                total += ways[t]
            ways[s] = total
        ids = [words[w] for w in order]
        return cls(np.array(arcs, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64),
                   np.array([d for d, _ in frozen], np.int64), np.cumsum([0, *map(len, ids)]).astype(np.int64),
                   np.array([i for x in ids for i in x], np.int64))

    def pack(self) -> bytes:
        parts = (self.arcs, self.targets, self.outputs, self.final, self.starts, self.ids)
        return np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]).tobytes()

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Memory-map packed bytes from an unnamed file of the task's own folder."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            flat = np.memmap(file, dtype=np.int64, mode="r")
        cuts = np.concatenate([[6], 6 + np.cumsum(flat[:6])])
        return cls(*(flat[a:b] for a, b in zip(cuts, cuts[1:])))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in sorted order, -1 for a word that is not in the lexicon."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.arcs):
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live = np.flatnonzero(sizes > 0)
        state, total = np.full(len(live), len(self.final) - 1, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * 256 + raw[at[live] + step]
            arc = np.searchsorted(self.arcs, key)
            hit = (arc < len(self.arcs)) & (self.arcs[np.minimum(arc, len(self.arcs) - 1)] == key)
            live, arc, total = live[hit], arc[hit], total[hit]
            state, total, step = self.targets[arc], total + self.outputs[arc], step + 1
            ended = sizes[live] == step
            good = ended & (self.final[state] == 1)
            out[live[good]] = total[good]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; keeps a bounded memo of words."""

    def __init__(self, path: str, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon = vocabulary(path), lexicon
        self.memo: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, v = self.memo, self.vocabulary
        new = [w for w in words if w not in memo]
        for w in [w for w in new if w in v.special]:
            memo[w] = np.array([v.special[w]], "<u4").tobytes()
        new = [w for w in new if w not in v.special]
        raw = [w.encode("utf-8", "replace") for w in new]
        for w, b, n in zip(new, raw, self.lexicon.numbers(raw).tolist()):
            memo[w] = np.asarray(self.lexicon.ids_of(n) if n >= 0 else v.merge(b), "<u4").tobytes()

    def encode(self, texts: list[str]):
        """Yield the ids of each text; words are resolved once per group of texts of bounded size."""
        group, size = [], 0
        for text in texts:
            pieces = self.vocabulary.pieces(text) if text else []
            group.append(pieces)
            size += len(pieces)
            if size > 200_000:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group):
        words: set[str] = set()
        for pieces in group:
            words.update(pieces)
        if len(words) > MEMO_WORDS:
            self.memo.clear()
        self.learn(words)
        get = self.memo.__getitem__
        for pieces in group:
            yield b"".join(map(get, pieces))

    def decode(self, ids: bytes) -> str:
        words = self.vocabulary.words
        return b"".join([words[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> list[str]:
    """The ``size`` most frequent words of all of ``docs``, by exact counts; of equal counts the smaller words."""

    def work(batch):
        counts: Counter = Counter()
        v = vocabulary(path)
        for t in batch.column(0).to_pylist():
            counts.update(v.pieces(t or ""))
            if len(counts) > MEMO_WORDS:
                yield {"word": list(counts), "n": list(counts.values())}
                counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    counted = arrow_map(docs.select("text"), work, "word string, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in top.select("word").collect()]


def compiled(docs: DataFrame, path: str) -> bytes:
    v = vocabulary(path)
    words = [w for w in frequent_words(docs, path) if w not in v.special]
    return Lexicon.compile({b: v.merge(b) for b in (w.encode() for w in words)}).pack()


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (binary), ``decoded`` of every row of ``docs``."""
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(compiled(docs, path))
    held: list[Encoder] = []

    def work(batch):
        if not held:
            held.append(Encoder(path, Lexicon.mapped(shared.value)))
        texts = batch.column(1).to_pylist()
        for at in range(0, len(texts), 256):
            ids = list(held[0].encode(texts[at : at + 256]))
            yield {"doc_id": batch.column(0).slice(at, 256), "ids": ids, "decoded": [held[0].decode(x) for x in ids]}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), work, "doc_id bigint, ids binary, decoded string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
