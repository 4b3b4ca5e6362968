"""BPE encoding and decoding by speculation.

Greedy longest match proposes a word's tokens. A sequence of tokens is what merging gives if
and only if each token is what its own characters merge to and no merge would have crossed the
border of any two neighbours; borders of many words are tested at once as arrays. Only words
that fail a test are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import bounded_batches
from .words import chunks

#: Distinct stretches of text whose tokens a worker remembers, twice at most.
REMEMBERED = 200_000
NEVER = 1 << 40
SPACES = regex.compile(r"\s+")
#: Separators that str.split() takes for white space and the vocabulary's pattern does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
HIGH = regex.compile("[\u0378-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> regex.Pattern:
    """Code points that unicodedata does not know."""
    runs: list[list[int]] = []
    for c in range(0x378, 0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class PairTable:
    """Rank of a token pair, looked up for many pairs at once: open addressing with linear steps."""

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(8, (4 * len(ranks)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NEVER, dtype=np.int64)
        left = np.array(list(ranks), dtype=np.int64)
        value = np.array(list(ranks.values()), dtype=np.int64)
        slot = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.key[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.rank[slot[put]] = left[put], value[put]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, value, slot = left[rest], value[rest], (slot[rest] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), NEVER, dtype=np.int64)
        open_, slot = np.arange(len(key)), self._slot(key)
        while len(open_):
            have = self.key[slot]
            hit = have == key[open_]
            out[open_[hit]] = self.rank[slot[hit]]
            on = ~hit & (have >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.key) - 1)
        return out


class WordBpe:
    """The tokenizer of a `tokenizers` file whose words end with a suffix: normalise, split into
    words, then tokens per word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path} is not a word BPE file of the kind that is supported")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letter = byte_letters()
        self.byte = {c: b for b, c in enumerate(self.letter)}
        self.library = Tokenizer.from_file(path)
        self.young = unassigned()  # younger than the character tables here: the library's own tables decide
        self.name = {i: t for t, i in (self.vocab | self.special).items()}
        self.reach: dict[str, int] = {}  # the longest token that starts with these two letters
        for t in self.vocab:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        ranks, self.part, made = {}, {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            ranks[a << 32 | b] = rank
            made.append(whole)
            self.part.setdefault(whole, (rank, a, b))  # the merge that makes a token
        self.ranks, self.made = PairTable(ranks), np.array(made, dtype=np.int64)
        self.leaf = np.array([self.vocab.get(chr(c), -1) for c in range(512)], dtype=np.int64)
        self.last_leaf = np.array([self.vocab.get(chr(c) + self.suffix, -1) for c in range(512)], dtype=np.int64)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.border: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.sound = self._sound_tokens()

    # ---- words ----

    def runs(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """Stretches without white space, and the special token that ends each part of a text."""
        parts = self.specials.split(text) if "<|" in text else [text]
        for k in range(0, len(parts), 2):
            if HIGH.search(parts[k]) and self.young.search(parts[k]):
                part = self.library.normalizer.normalize_str(parts[k])
            else:
                part = unicodedata.normalize("NFC", parts[k])
                part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            split = SPACES.split(part) if SEPARATORS.search(part) else part.split()
            yield (parts[k + 1] if k + 1 < len(parts) else None), split

    def words(self, run: str) -> list[str]:
        """The words of a stretch, in letters that stand for bytes."""
        if run.isascii() and run.isalpha():
            return [run]
        if HIGH.search(run) and self.young.search(run):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(run)]
        letter = self.letter
        return [w if w.isascii() and w.isprintable() else "".join([letter[b] for b in w.encode()]) for w in self.pattern.findall(run)]

    # ---- tokens of a word ----

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the last token carries the suffix. Nothing if a letter is not in the vocabulary."""
        out, at, n = [], 0, len(word)
        get, suffix, reach = self.vocab.get, self.suffix, self.reach.get
        while True:
            far = reach(word[at : at + 2], 1)
            if n - at <= far and (token := get(word[at:] + suffix)) is not None:
                out.append(token)
                return out
            for end in range(min(n - 1, at + far), at, -1):
                if (token := get(word[at:end])) is not None:
                    out.append(token)
                    at = end
                    break
            else:
                if n - at > 1:
                    return []
                token = get(word[at:] + suffix)
                return [*out, token] if token is not None else []

    def merged(self, words: list[str], ended: bool = True) -> list[list[int]]:
        """Exact merging of many words at once: in each round every word joins its pair of lowest
        rank, wherever it stands, from the left."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ids = self.leaf[np.minimum(code, 511)]
        if ended:
            last = np.cumsum(size) - 1
            ids[last] = self.last_leaf[np.minimum(code[last], 511)]
        owner = np.repeat(np.arange(len(words)), size)
        have = ids >= 0  # letters that the vocabulary lacks have no token
        ids, owner = ids[have], owner[have]
        done_ids, done_owner = [], []
        rank = np.full(len(ids), NEVER, dtype=np.int64)
        fresh = np.arange(len(ids))
        while len(ids):
            pair = fresh[fresh + 1 < len(ids)]
            pair = pair[owner[pair] == owner[pair + 1]]
            rank[fresh] = NEVER
            rank[pair] = self.ranks(ids[pair] << 32 | ids[pair + 1])
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            count = np.diff(np.append(start, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, start), count)
            done = best == NEVER
            done_ids.append(ids[done])
            done_owner.append(owner[done])
            ids, owner, rank, best = ids[~done], owner[~done], rank[~done], best[~done]
            if not len(ids):
                break
            join = np.flatnonzero(rank == best)
            new = np.ones(len(join), dtype=bool)
            new[1:] = join[1:] != join[:-1] + 1
            head = np.maximum.accumulate(np.where(new, np.arange(len(join)), 0))
            join = join[(np.arange(len(join)) - head) % 2 == 0]
            ids[join] = self.made[rank[join]]
            keep = np.ones(len(ids), dtype=bool)
            keep[join + 1] = False
            place = np.cumsum(keep) - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at = place[join]
            fresh = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
        owner, ids = np.concatenate(done_owner), np.concatenate(done_ids)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]
        return [x.tolist() for x in np.split(ids[order], ends)]

    # ---- verification ----

    def _sound_tokens(self) -> set[int]:
        """Tokens that their own letters merge to."""
        ending = [t for t in self.vocab if t.endswith(self.suffix)] if self.suffix else []
        inner = [t for t in self.vocab if not (self.suffix and t.endswith(self.suffix))]
        whole = self.merged([t[: len(t) - len(self.suffix)] for t in ending]) + self.merged(inner, ended=False)
        return {self.vocab[t] for t, ids in zip(ending + inner, whole) if ids == [self.vocab[t]]}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The symbols that stand at a token's right (1) or left (0) end while it is merged:
        (symbol, rank that made it, rank that used it up)."""
        if (token, side) not in self.edges:
            out, used, at = [], NEVER, token
            while at in self.part:
                rank = self.part[at][0]
                out.append((at, rank, used))
                used, at = rank, self.part[at][1 + side]
            out.append((at, -1, used))
            self.edges[token, side] = out
        return self.edges[token, side]

    def borders_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For token pairs, whether no merge crosses from one to the other. A pair (a, b) of end
        symbols would merge if both stand at the same time and its rank comes before either is used
        up; of equal ranks the leftmost goes first, so before a's use and not after b's."""
        a_of = [self._edge(t, 1) for t in left.tolist()]
        b_of = [self._edge(t, 0) for t in right.tolist()]
        size = np.array([len(a) * len(b) for a, b in zip(a_of, b_of)])
        grid = np.array([(*x, *y) for a, b in zip(a_of, b_of) for x in a for y in b], dtype=np.int64).reshape(-1, 6)
        rank = self.ranks(grid[:, 0] << 32 | grid[:, 3])
        together = np.maximum(grid[:, 1], grid[:, 4]) < np.minimum(grid[:, 2], grid[:, 5])
        crossed = together & (rank < grid[:, 2]) & (rank <= grid[:, 5]) & (rank < NEVER)
        return np.bincount(np.repeat(np.arange(len(size)), size), weights=crossed, minlength=len(size)) == 0

    def tokens(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words: proposed, verified all at once, and merged where that fails."""
        proposed = [self.propose(w) for w in words]
        keys = {a << 32 | b for ids in proposed for a, b in zip(ids, ids[1:])}
        if len(self.border) > 2 * REMEMBERED:
            self.border.clear()
        new = np.array([k for k in keys if k not in self.border], dtype=np.int64)
        if len(new):
            self.border.update(zip(new.tolist(), self.borders_hold(new >> 32, new & 0xFFFFFFFF).tolist()))
        border, sound = self.border, self.sound
        failed = [k for k, ids in enumerate(proposed) if not ids or not all([border[a << 32 | b] for a, b in zip(ids, ids[1:])]) or not sound.issuperset(ids)]
        for k, ids in zip(failed, self.merged([words[k] for k in failed])):
            proposed[k] = ids
        return proposed

    def learn(self, runs: set[str]) -> None:
        """Remembers the tokens of new stretches. The older half of what is known goes when there is too much."""
        known, older = self.known, self.older
        for r in runs:
            if r not in known and (have := older.get(r)) is not None:
                known[r] = have
        todo = [r for r in runs if r not in known]
        split = [self.words(r) for r in todo]
        words = list({w for ws in split for w in ws})
        name = self.name
        coded = {w: (ids, " ".join([name[i] for i in ids])) for w, ids in zip(words, self.tokens(words))}
        for r, ws in zip(todo, split):
            got = [coded[w] for w in ws]
            ids = [i for g in got for i in g[0]]
            known[r] = (np.array(ids, dtype="<u4").tobytes(), " ".join([g[1] for g in got if g[0]]).encode())

    # ---- texts ----

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        cut = [list(self.runs(t)) for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.learn({r for parts in cut for _, runs in parts for r in runs})
        known, out = self.known, []
        for parts in cut:
            got = []
            for after, runs in parts:
                got += [known[r] for r in runs]
                if after is not None:
                    got.append((self.special[after].to_bytes(4, "little"), after.encode()))
            ids = b"".join([g[0] for g in got])
            out.append((ids, b" ".join([g[1] for g in got if g[0]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, joined by spaces: the file names no decoder."""
        return " ".join(self.name[i] for i in ids.tolist() if i in self.name)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One for each worker process."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(path: str, with_ids: bool, chunk: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_text"]
            for part, raw in chunks(batch, "_text", chunk):  # what is decoded leaves a little at a time
                got = bpe.encode_all([t.decode() for t in raw])
                out = [part.column(n) for n in names] + [pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d).hexdigest() for _, d in got])]
                if with_ids:
                    out += [pa.array([np.frombuffer(i, dtype="<u4").astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([d.decode() for _, d in got], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=names + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)

    return run


def bpe_encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns one row per row of `docs`: the id, n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 and, if asked for, ids and decoded. A null or empty
    text has no tokens and decodes to the empty text. Special tokens' strings in a text become
    those tokens; none are added. Texts are encoded whole, in one task each, without a shuffle;
    repeated rows give repeated results. Other columns are not read. An empty table gives none.
    The file at `path` must be on every executor.
    """
    bounded_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(_encode(path, with_ids), schema)
