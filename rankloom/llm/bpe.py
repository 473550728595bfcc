"""BPE encoding by a trie of distinct words that carries last-token states.

The encoding of every prefix of a word ends with exactly one token, and what
stands before that token is the encoding of a shorter prefix. A trie node
stands for a prefix shared by any number of words, so one state per node, the
last token and the node where it begins, holds the encodings of all of them.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from rankloom.llm.texts import map_texts

#: Bytes of the word tables, by estimate, above which a worker begins new ones and
#: keeps the last ones to look words up in; and bytes that an entry and a character take.
TABLE_BYTES, ENTRY_BYTES, LETTER_BYTES = 256 << 20, 200, 6
#: A worker begins a new trie at one node for so many bytes of these.
NODE_BYTES = 400
#: A worker forgets what it knows of pairs above so many.
MAX_PAIRS = 150_000
#: Words that are encoded at once.
WORDS_AT_ONCE = 20_000
#: Code points below this have neither combining marks nor case rules of context.
PLAIN_END = 0x250


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordTrie:
    """Encodes words of a BPE vocabulary whose last symbol bears a word-end mark.

    Words arrive as byte-level strings. ``encode`` inserts a set of words,
    propagates states depth-first through the nodes that are new, and reads each
    word's tokens back along the states.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str) -> None:
        self.vocab, self.end, self.letters = vocab, end, byte_letters()
        self.packed = {t: struct.pack("<I", i) for t, i in vocab.items()}
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        made = {a + b: (a, b, i) for (a, b), i in self.rank.items()}
        self.right = {t: self._spine(t, made, 1) for t in vocab}
        self.left = {t: self._spine(t, made, 0) for t in vocab}
        #: Beginnings of tokens: what a suffix can still grow into.
        self.begun = {t[:i] for t in vocab for i in range(len(t) - len(end) * t.endswith(end) + 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.grown: dict[tuple[str, str], tuple[str, list[tuple[str, int]]]] = {}
        self.clear()

    @staticmethod
    def _spine(token: str, made: dict, side: int) -> list[tuple[str, int]]:
        """The token and its outermost parts on one side, each with the rank of
        the merge that uses it up."""
        spine = [(token, 1 << 60)]
        while token in made:
            used = made[token][2]
            token = made[token][side]
            spine.append((token, used))
        return spine

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[str] = [""]
        self.back: list[int] = [0]
        self.tail: list[str] = [""]
        for pairs in (self.fits, self.grown):
            if len(pairs) > MAX_PAIRS:
                pairs.clear()

    def adjacent(self, left: str, right: str) -> bool:
        """May ``right`` follow ``left`` in an encoding?

        Not if some merge across the border comes before both its parts are used
        up inside their tokens. At equal rank the merge further left comes first.
        """
        rank = self.rank
        for x, used_x in self.right[left]:
            for y, used_y in self.left[right]:
                r = rank.get((x, y))
                if r is not None and r < used_x and r <= used_y:
                    return False
        return True

    def grow(self, tail: str, symbol: str) -> tuple[str, list[tuple[str, int]]]:
        """The longest suffix that some token begins with, after one more symbol,
        and the tokens that end there with their lengths, longest first."""
        whole, mark = (tail + symbol[0], self.end) if len(symbol) > 1 else (tail + symbol, "")
        ends = [(whole[i:] + mark, len(whole) - i) for i in range(len(whole)) if whole[i:] + mark in self.vocab]
        while whole not in self.begun:
            whole = whole[1:]
        if not ends:
            raise ValueError(f"the vocabulary does not cover {symbol!r}")
        got = self.grown[tail, symbol] = (whole, ends)
        return got

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed token ids of each distinct word."""
        packed, child, last, back, tail, fits, grown, end = self.packed, self.child, self.last, self.back, self.tail, self.fits, self.grown, self.end

        def state(nodes: list[int], ends: list[tuple[str, int]]) -> tuple[str, int]:
            """Last token of a prefix and the node where it begins."""
            for token, size in ends:
                node = nodes[-size]
                if not node:
                    return token, node
                pair = last[node], token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.adjacent(*pair)
                if fit:
                    return token, node
            raise ValueError("the merges give no encoding")

        out: dict[str, bytes] = {}
        # In sorted order a walk from word to word is a depth-first walk of the trie.
        nodes, path = [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del nodes[shared + 1 :]
            path = word[:-1]
            node = nodes[-1]
            for symbol in path[shared:]:
                at = node << 9 | ord(symbol)
                below = child.get(at)
                if below is None:
                    grew = tail[node], symbol
                    suffix, ends = grown.get(grew) or self.grow(*grew)
                    token, begin = state(nodes, ends)
                    below = child[at] = len(last)
                    last.append(token)
                    back.append(begin)
                    tail.append(suffix)
                node = below
                nodes.append(node)
            grew = tail[node], word[-1] + end
            token, node = state(nodes, (grown.get(grew) or self.grow(*grew))[1])
            ids = packed[token]
            while node:
                ids = packed[last[node]] + ids
                node = back[node]
            out[word] = ids
        return out


def _class(test: Callable[[str], bool]) -> str:
    return "".join(re.escape(c) for c in map(chr, range(PLAIN_END)) if test(c))


class WordBpe:
    """Encoder and decoder for a word-end BPE file of the tokenizers library.

    Texts of code points below ``PLAIN_END`` are cut by one regular expression.
    Others, where normal forms and letter classes depend on Unicode versions,
    are normalised and cut by the library's own components, then encoded alike.
    """

    def __init__(self, path: str, tables: int = TABLE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tables = tables
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.prepare(model)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # Fixed by the file: contractions, runs of letters, single numerals, runs of other signs.
        letters = _class(lambda c: unicodedata.category(c)[0] == "L")
        numerals = _class(lambda c: unicodedata.category(c)[0] == "N")
        space = "\t\n\v\f\r \x85\xa0"
        self.cut = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numerals}]|[^{space}{letters}{numerals}]+").findall
        # Separators of fields to records are white space to Python alone.
        self.odd = re.compile(f"[\x1c-\x1f{chr(PLAIN_END)}-\U0010ffff]").search
        self.clear()

    def prepare(self, model: dict) -> None:
        self.trie = WordTrie(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])

    def words(self, text: str) -> list[str]:
        """Byte-level words of any text, by the library's own components."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def byte_level(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode("utf-8")))

    def clear(self) -> None:
        self.trie.clear()
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.renew()

    def renew(self) -> None:
        """Begin new tables; words of the last ones move over when they are met again."""
        self.known_before, self.known = self.known, {}
        self.runs_before, self.runs = self.runs, {}
        self.held = 0

    def hold(self, table: dict[str, bytes], entries: dict[str, bytes]) -> None:
        table.update(entries)
        self.held += ENTRY_BYTES * len(entries) + LETTER_BYTES * sum(map(len, entries))

    def learn(self, words: set[str]) -> None:
        """Encode byte-level words that are new to the tables, many at once."""
        fresh = words.difference(self.known)
        again = {w: self.known_before[w] for w in fresh.intersection(self.known_before)}
        self.hold(self.known, again)
        new = sorted(fresh.difference(again))
        for lo in range(0, len(new), WORDS_AT_ONCE):
            if len(self.trie.last) > self.tables // NODE_BYTES:
                self.trie.clear()
            self.hold(self.known, self.trie.encode(new[lo : lo + WORDS_AT_ONCE]))

    def learn_runs(self, fresh: set[str]) -> None:
        """Encode runs of plain text without white space; no word crosses their ends."""
        level, cut, spelt, whole = self.byte_level, self.cut, {}, {}
        again = {r: self.runs_before[r] for r in fresh.intersection(self.runs_before)}
        self.hold(self.runs, again)
        for run in fresh.difference(again):
            if run.isascii() and run.isalpha():
                whole[run] = run.lower()
            else:
                spelt[run] = [w if w.isascii() and w.isprintable() else level(w) for w in cut(run.lower())]
        self.learn({w for ws in spelt.values() for w in ws}.union(whole.values()))
        look = self.known.__getitem__
        self.hold(self.runs, {r: look(w) for r, w in whole.items()})
        self.hold(self.runs, {r: b"".join(map(look, ws)) for r, ws in spelt.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the tokenizers library gives without added special
        tokens, packed as little-endian unsigned 32-bit integers."""
        if self.held > self.tables:
            self.renew()
        parts, fresh_runs, fresh_words = [], set(), set()
        for text in texts:
            cut = []
            for i, part in enumerate(self.at_special.split(text) if "<|" in text else [text]):
                if i % 2:
                    cut.append((None, part))
                elif not self.odd(part):
                    runs = part.split()
                    fresh_runs |= set(runs).difference(self.runs)
                    cut.append((self.runs, runs))
                else:
                    words = self.words(part)
                    fresh_words.update(words)
                    cut.append((self.known, words))
            parts.append(cut)
        self.learn_runs(fresh_runs)
        self.learn(fresh_words)
        return [b"".join([struct.pack("<I", self.special[x]) if table is None else b"".join(map(table.__getitem__, x)) for table, x in cut]) for cut in parts]

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so tokens are joined by blanks."""
        return " ".join(map(self.names.__getitem__, ids))


class Met(dict):
    """A table whose entries are made when they are first looked up."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class LibraryBpe(WordBpe):
    """The same ids with each distinct word encoded by the library's own model, when it is first met."""

    def prepare(self, model: dict) -> None:
        self.model, self.packed = self.library.model, {i: struct.pack("<I", i) for i in self.names}

    def clear(self) -> None:
        self.known, self.runs = {}, {}
        self.renew()

    def renew(self) -> None:
        self.known_before, self.known = self.known, Met(self.encode_word)
        self.runs_before, self.runs = self.runs, Met(self.encode_run)
        self.held = 0

    def encode_word(self, word: str) -> bytes:
        """Ids of a byte-level word."""
        self.held += ENTRY_BYTES + LETTER_BYTES * len(word)
        ids = self.known_before.get(word)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(word)]) if ids is None else ids

    def encode_run(self, run: str) -> bytes:
        """Ids of a run of plain text without white space; no word crosses its ends."""
        self.held += ENTRY_BYTES + LETTER_BYTES * len(run)
        ids = self.runs_before.get(run)
        if ids is not None:
            return ids
        run = run.lower()
        if run.isascii() and run.isalpha():
            return self.known[run]
        return b"".join([self.known[w if w.isascii() and w.isprintable() else self.byte_level(w)] for w in self.cut(run)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.tables:
            self.renew()
        return list(map(self.encode_text, texts))

    def encode_text(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self.at_special.split(text) if "<|" in text else [text]):
            if i % 2:
                out.append(self.packed[self.special[part]])
            elif not self.odd(part):
                out += map(self.runs.__getitem__, part.split())
            else:
                out += map(self.known.__getitem__, self.words(part))
        return b"".join(out)


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


_OPEN: dict[tuple[str, type[WordBpe]], WordBpe] = {}


def word_bpe(path: str, tables: int = TABLE_BYTES, kind: type[WordBpe] = WordBpe) -> WordBpe:
    """The encoder of a file, opened once per worker process. ``tables`` bounds its
    word tables, in bytes: less memory, more words encoded again, equal ids."""
    if (path, kind) not in _OPEN:
        _OPEN[path, kind] = kind(path)
    _OPEN[path, kind].tables = tables
    return _OPEN[path, kind]


def encode_texts(df: DataFrame, vocabulary: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add each text's token ids (array of ints), and on demand the decoded text.

    ``vocabulary`` is a file that every executor can open. A null or empty text
    has no ids and decodes to an empty text. Rows are independent, so ties and
    repeated rows need no rule; input columns of the same names give way.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    def make():
        codec = word_bpe(vocabulary)

        def fn(column):
            got = codec.encode([t or "" for t in column.to_pylist()])
            sizes = np.cumsum([0, *map(len, got)]) // 4
            arrays = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))]
            if decoded:
                arrays.append(pa.array([codec.decode(unpack(g)) for g in got], pa.string()))
            return arrays

        return fn

    return map_texts(df, text, make, fields)


def encode_digests(df: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """As ``encode_texts``, with a count and digests in place of ids and decoded text."""
    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]

    def make():
        codec = word_bpe(vocabulary)

        def fn(column):
            got = codec.encode([t or "" for t in column.to_pylist()])
            return [
                pa.array([len(g) // 4 for g in got], pa.int64()),
                pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string()),
                pa.array([hashlib.sha256(codec.decode(unpack(g)).encode()).hexdigest() for g in got], pa.string()),
            ]

        return fn

    return map_texts(df, text, make, fields)
