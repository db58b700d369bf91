"""BPE encoding and decoding of whole texts, by batched numpy merge rounds.

The words that a batch of texts brings in for the first time are encoded together: their symbols lie in one flat array, every
round looks up all neighbouring pairs by binary search over the sorted pair keys of the merge table, finds the lowest rank of each
word with a segmented minimum, and merges it. A word that was seen before comes from a bounded memo of the worker.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to the empty string; the literal special
strings in a text become their own ids, as the tokenizer's file says; code points younger than Python's Unicode tables count as
unassigned; repeated rows give repeated results; very long texts are encoded whole, one at a time; an empty table gives no rows; columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np

_NONE = np.iinfo(np.int64).max


#: Unicode's white space.
_WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(kind: str) -> str:
    """The inside of a character class with all code points of a general category, by Python's own Unicode tables."""
    member = [unicodedata.category(chr(c))[0] == kind for c in range(0x110000)]
    edges = np.flatnonzero(np.diff(np.array([False, *member, False], np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in keep}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBPE:
    """A tokenizer file of kind 'BPE with word ends', read from `path` (a parameter; files are never copied)."""

    def __init__(self, path: str, memo_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for word, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = word
        alphabet = _byte_alphabet()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[alphabet[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], rank[order], made
        # A merge is safe to apply at all its places of a word at once if no pair with its product ranks lower.
        least = np.full(self.size, _NONE)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.safe = least[made] > rank
        split = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"][0]["pattern"]["Regex"]
        classes = {"\\p{L}": _ranges("L"), "\\p{N}": _ranges("N"), "\\s": _WHITE}
        for name, ranges in classes.items():
            split = split.replace(name, ranges)
        self.words = re.compile(split + "|\n").findall
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.gaps = re.compile(f"[^{_WHITE}]+").findall
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *self.special]
        self.memo_words = memo_words
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.spelled: list[str] = []
        self.pool = np.array(list(self.special.values()), np.uint32)  # the ids of all words in the memo, one after another
        self.length = np.ones(len(self.special), np.int64)
        for word in self.special:
            self.memo["\0 " + word] = len(self.spelled)
            self.spelled.append(word)
        self.start = np.cumsum(self.length) - self.length

    def forget(self) -> None:
        """Drops the words in the memo; a worker that waits for other stages need not hold them."""
        self._reset()

    def split(self, text: str | None) -> list[str]:
        """The pieces of a text that are encoded alone: between white space, and special strings behind a NUL and a blank.

        No word, and no composition of characters, reaches over white space. Python also splits at four control characters
        that are no white space to the tokenizer, so a text with one of them is cut by pattern.
        """
        if not text:
            return []
        if any(map(text.__contains__, self.odd)):
            out, at = [], 0
            for m in self.marks.finditer(text) if self.marks else ():
                out += self.gaps(text[at : m.start()])
                out.append("\0 " + m[0])
                at = m.end()
            return out + self.gaps(text[at:])
        return text.split()

    @staticmethod
    def normal(text: str) -> str:
        # Lower case goes character by character: a final sigma is no special case.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, flat, and their number in each word; all words are merged together, round by round."""
        data = [w.encode("utf-8") for w in words]
        if not data:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lengths = np.array([len(b) for b in data], np.int64)
        sym = self.inner[np.frombuffer(b"".join(data), np.uint8)]
        ends = np.cumsum(lengths) - 1
        last = np.frombuffer(bytes(b[-1] for b in data), np.uint8)
        sym[ends] = self.final[last]
        word = np.repeat(np.arange(len(data)), lengths)
        rank = self._rank(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low_of = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            open_word = low_of != _NONE
            if not open_word.all():  # words without a pair to merge are finished
                done_sym.append(sym[~open_word])
                done_word.append(word[~open_word])
                sym, word, rank, low_of = sym[open_word], word[open_word], rank[open_word], low_of[open_word]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low_of)
            # In a run of touching places (a a a), every second counts; where a merge isn't safe, only the first of the word.
            touch = np.append(False, (np.diff(hit) == 1) & (word[hit[1:]] == word[hit[:-1]]))
            start = np.maximum.accumulate(np.where(touch, 0, np.arange(len(hit))))
            take = (np.arange(len(hit)) - start) % 2 == 0
            lead = np.append(True, word[hit[1:]] != word[hit[:-1]])
            hit = hit[take & (self.safe[rank[hit]] | lead)]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))  # where the merged symbols are now; only their pairs have changed
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = self._rank(sym, word, at)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(data))

    def _rank(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The merge rank of the pairs that start at the given places; the largest number where there is none."""
        to = np.minimum(at + 1, len(sym) - 1)
        key = np.where((word[at] == word[to]) & (to > at), sym[at] * self.size + sym[to], -1)
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found], _NONE)

    def _learn(self, lists: list[list[str]]) -> None:
        memo = self.memo
        new = list({w for words in lists for w in words if w not in memo})
        pools, lengths = [self.pool], [self.length]
        for at in range(0, len(new), 20_000):
            block = new[at : at + 20_000]
            flat = self.words(self.normal("\n".join(block)))  # no piece holds a line feed
            ids, count = self.merge([w for w in flat if w != "\n"])
            ends = np.append(0, np.cumsum(count))
            breaks = np.flatnonzero(np.array([w == "\n" for w in flat], bool))
            cuts = ends[np.concatenate([[0], breaks - np.arange(len(breaks)), [len(count)]])]
            pools.append(ids)
            lengths.append(np.diff(cuts))
            tokens = list(map(self.token.__getitem__, ids.tolist()))
            cuts = cuts.tolist()
            memo.update(zip(block, range(len(self.spelled), len(self.spelled) + len(block)), strict=True))
            self.spelled += [" ".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        if new:
            self.pool, self.length = np.concatenate(pools), np.concatenate(lengths)
            self.start = np.cumsum(self.length) - self.length

    def encode_batch(self, texts: list[str | None]):
        """Yields (ids, decoded) of each text."""
        lists = [self.split(t) for t in texts]
        if len(self.memo) > self.memo_words:
            self._reset()
        self._learn(lists)
        place, spelled = self.memo.__getitem__, self.spelled.__getitem__
        for words in lists:
            at = list(map(place, words))
            which = np.array(at, np.int64)
            length = self.length[which]
            before = np.cumsum(length) - length
            found = np.arange(int(length.sum())) + np.repeat(self.start[which] - before, length)
            yield self.pool[found], " ".join(filter(None, map(spelled, at)))

    def decode(self, ids) -> str:
        """The tokens joined by blanks, as a tokenizer file without decoder asks for; special tokens are kept."""
        return " ".join([self.token[i] for i in ids])


_LOADED: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    """One tokenizer for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode(docs, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True):
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row; a narrow stage, no shuffle."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from .common import chunks, give_back, prepare

    prepare(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                n, h, d, all_ids, all_text = [], [], [], [], []
                for ids, decoded in bpe.encode_batch(texts[a:b]):
                    n.append(len(ids))
                    h.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    d.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                        all_text.append(decoded)
                out = [keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(h), pa.array(d)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)
        bpe.forget()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(tokens, path: str, id_col: str = "doc_id", ids_col: str = "ids"):
    """(id, decoded) of every row's token ids; null ids decode to the empty string."""
    import pyarrow as pa

    from .common import prepare

    prepare(tokens.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            out = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "decoded"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, decoded string")
