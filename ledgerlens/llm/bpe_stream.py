"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

A byte string has one valid token sequence, and a sequence is valid exactly if every two
neighbours are: merging their joined bytes gives the two again. So the encoding of each prefix
is the encoding of a shorter prefix and one last token, and the transducer needs to keep only
that last token for each position, which it works out where a path asks for it. A longer prefix,
however it goes on, has a token boundary among the last `lookahead` positions, where `lookahead` is
the longest token that the merge list can make. Tokens on which the paths of all those positions
agree can't change any more: they are emitted and forgotten. What is kept doesn't grow with the text.

Every pretoken goes through the transducer, but for those remembered of late. Of a block of texts,
the short ones that aren't remembered go through it abreast: a step reads the next byte of each of
them, and works out their last tokens in arrays. Texts are read in windows, cut where no pretoken
lies across: before space that follows other characters, and between a letter and what is neither
letter nor space; of what has no such place, a pretoken at a time.

Null and empty texts have no tokens. Added tokens (such as `<|endoftext|>`) are cut out of the
text first. Rows are independent: repeated rows and ids give repeated results. Result columns take
the place of columns of the same name.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import operator
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ledgerlens.llm._spark import ddl, map_texts, with_text, without

#: Fixed value: how byte-level tokenizers split a text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts and token pairs that are remembered, characters read at a time, and characters of texts whose pretokens go abreast.
REMEMBERED, PAIRS, WINDOW, BLOCK = 160_000, 400_000, 1 << 16, 1 << 20
#: Bytes of a pretoken that goes abreast at most; pairs that arrays remember, as a power of 2.
ABREAST, PAIR_BITS = 64, 20
#: Bytes of a beginning whose last token is remembered.
BEGINNING = 7
#: A character of space by Python's rules, which windows cut by Arrow lack; and windows with space other than single spaces
#: and line ends between other characters, as a pattern of Arrow's.
BARE, ODD = "\x1f", r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n "
#: The rank of what no merge joins.
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes and merge ranks of a byte-level BPE file of the tokenizers library, by its path; or as `vars` gave them."""

    def __init__(self, source: str | dict):
        if isinstance(source, dict):
            self.__dict__.update(source)
            return
        with open(source, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for text, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.byte_ids = {b: ids[c] for c, b in letters.items() if c in ids}
        # each worker holds these tables: the rank of a merge by its pair, and by token the first merge that makes it (left, right, rank)
        self.across: dict[int, int] = {}
        self.made = np.full((len(self.bytes), 3), -1, np.int32)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            known = self.across.setdefault(ids[a] << 20 | ids[b], rank)
            if known == rank and self.made[ids[a + b], 2] < 0:
                self.made[ids[a + b]] = ids[a], ids[b], rank
        self.by_bytes = {self.bytes[i]: i for i in self.byte_ids.values()}
        self.by_bytes |= {self.bytes[i]: i for i in np.flatnonzero(self.made[:, 2] >= 0).tolist()}
        self.sizes = list(map(len, self.bytes))
        self.pairs, self.ranks = np.array(sorted(self.across.items()), np.int64).reshape(-1, 2).T.copy()
        self.base, self.check, self.ended = self._backwards()
        # both ends of all tokens in arrays: where a token's pieces begin, the pieces and their ranks
        self.ends = []
        for side in (0, 1):
            edges = [self.edge(token, side) for token in range(len(self.bytes))]
            begin = np.cumsum([0, *map(len, edges)])[:-1].astype(np.int32)
            self.ends.append((begin, *np.array([piece for edge in edges for piece in edge], np.int32).T.copy()))

    def _backwards(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A trie of the tokens read from their ends, as a double array.

        The child of place p (the root's is 0) by a byte is at base[p] + byte, if check there is p;
        the token of a place, or -1, is in the third array.
        """
        children, tokens = [{}], [-1]
        for said, i in self.by_bytes.items():
            node = 0
            for byte in reversed(said):
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    tokens.append(-1)
                node = children[node][byte]
            tokens[node] = i
        free = np.ones(2 * len(children) + (1 << 12), bool)
        base, low, free[0] = np.zeros(len(children), np.int64), 1, False
        # those with most children first, each at the next place where all of them find room; only children fill what is left
        for node in sorted((n for n, x in enumerate(children) if len(x) > 1), key=lambda n: -len(children[n])):
            while True:
                if low + 1024 > len(free):
                    free = np.append(free, np.ones(len(free), bool))
                room = np.logical_and.reduce([free[low + byte : low + byte + 512] for byte in children[node]])
                if room.any():
                    break
                low += 512
            base[node] = low + int(room.argmax())
            free[base[node] + list(children[node])] = False
        only = [(n, *x) for n, x in enumerate(children) if len(x) == 1]
        free = np.append(free, np.ones(len(only) + 256, bool))
        for (node, byte), place in zip(only, np.flatnonzero(free[256:])[: len(only)] + 256):
            base[node] = place - byte
        places = np.zeros(len(children), np.int64)
        for node, below in enumerate(children):
            for byte, child in below.items():
                places[child] = base[node] + byte
        size = max(int(places.max()), int(base.max())) + 256
        arrays = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        arrays[0][places], arrays[2][places] = base, tokens
        for node, below in enumerate(children):
            arrays[1][[places[child] for child in below.values()]] = places[node]
        return arrays

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at a token's left (0) or right (1) end, as the merges build it up.

        A piece comes with the rank of the merge that takes it in; the token itself has none.
        """
        pieces = [(token, NEVER)]
        while (made := self.made[token].tolist())[2] >= 0:
            token = made[side]
            pieces.append((token, made[2]))
        return pieces[::-1]


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Bytes within which any continuation has a token boundary: the longest token of the merge list."""
    return max(map(len, vocabulary.by_bytes))


class Transducer:
    """Reads the bytes of one pretoken and emits its tokens once they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lookahead = sufficient_lookahead(vocabulary)
        self.begun: dict[bytes, int] = {}  # the last tokens of short beginnings of pretokens
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.across = vocabulary.across
        self._fits: dict[int, bool] = {}
        self.trie = tuple(map(memoryview, (vocabulary.base, vocabulary.check, vocabulary.ended)))
        self.sizes = np.array(vocabulary.sizes)
        self.met = np.full(1 << PAIR_BITS, -1, np.int64)  # pairs and, as the last bit, whether they fit, at places by their hash

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are, side by side."""
        pair = left << 20 | right
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[pair] = self._stay_apart(self._edge(left, 1), self._edge(right, 0))
        return known

    def _edge(self, token: int, side: int) -> list:
        known = self.edges[side].get(token)
        if known is None:
            known = self.edges[side][token] = self.vocabulary.edge(token, side)
        return known

    def _stay_apart(self, right: list, left: list) -> bool:
        """Replays both tokens' merges by rank, looking for one that crosses the boundary first."""
        rank_of = self.across.get
        i = j = 0
        a, next_a = right[0]
        b, next_b = left[0]
        while True:
            across = rank_of(a << 20 | b, NEVER)
            if across < next_a and across <= next_b and across < NEVER:
                return False
            if next_a <= next_b:
                if next_a == NEVER:
                    return True
                i += 1
                a, next_a = right[i]
            else:
                j += 1
                b, next_b = left[j]

    def _last(self, kept: bytes, i: int, last: list[int | None]) -> int:
        """The last token of the encoding of kept[:i]; those of shorter prefixes are worked out as far as it asks for them."""
        token = last[i]
        if token is None:
            begins = i <= BEGINNING and last[0] == -1
            if begins and (token := self.begun.get(kept[:i])) is not None:
                last[i] = token
                return token
            (base, check, ended), fits = self.trie, self._fits.get
            node, at, found = 0, i, []
            while at and check[child := base[node] + kept[at - 1]] == node:
                node, at = child, at - 1
                if (token := ended[node]) >= 0:
                    found.append((at, token))
            for start, token in reversed(found):  # the longest first
                before = last[start]
                if before is None:
                    before = self._last(kept, start, last)
                if before < 0:
                    break
                fit = fits(before << 20 | token)
                if self.fits(before, token) if fit is None else fit:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last[i] = token
            if begins and len(self.begun) < REMEMBERED:
                self.begun[kept[:i]] = token
        return token

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`fits` for pairs in arrays; everything fits after nothing (-1)."""
        pairs = left << 20 | right
        places = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        met = self.met.take(places)
        new = np.flatnonzero(((met >> 1) != pairs) & (left >= 0))
        if new.size:
            unknown, which = np.unique(pairs[new], return_inverse=True)
            met[new] = (unknown << 1 | self._all_stay_apart(unknown >> 20, unknown & 0xFFFFF))[which]
            self.met[places[new]] = met[new]
        return (met & 1).astype(bool) | (left < 0)

    def _all_stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`_stay_apart` for pairs of tokens in arrays."""
        (begin_b, pieces_b, ranks_b), (begin_a, pieces_a, ranks_a) = self.vocabulary.ends
        known, ranks = self.vocabulary.pairs, self.vocabulary.ranks
        apart, who = np.zeros(len(left), bool), np.arange(len(left))
        i, j = begin_a[left], begin_b[right]
        while who.size:
            next_a, next_b = ranks_a[i], ranks_b[j]
            pairs = pieces_a[i].astype(np.int64) << 20 | pieces_b[j]
            at = np.searchsorted(known[:-1], pairs)
            across = np.where(known[at] == pairs, ranks[at], NEVER) if len(known) else np.full(len(who), NEVER)
            crossed = (across < next_a) & (across <= next_b)
            first = next_a <= next_b
            done = first & (next_a == NEVER) & ~crossed
            apart[who[done]] = True
            on = ~(crossed | done)
            who, i, j = who[on], (i + first)[on], (j + ~first)[on]
        return apart

    def _abreast(self, words: list[bytes]) -> list[bytes]:
        """The ids of short pretokens, read side by side: for each of their beginnings the last token, then the paths back."""
        base, check, ended = self.vocabulary.base, self.vocabulary.check, self.vocabulary.ended
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")  # the longest first: those that go on are the first ones
        data, starts, lengths = np.frombuffer(b"".join(words), np.uint8), (np.cumsum(lengths) - lengths)[order], lengths[order]
        going = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), "right").tolist()
        said, last = [], [np.full(len(words), -1)]
        for i, n in enumerate(going[1:], 1):
            said.append(data.take(starts[:n] + (i - 1)))
            who, node, found = np.arange(n), np.zeros(n, np.int64), []
            for k in range(1, i + 1):
                child = base.take(node) + said[i - k].take(who)
                on = np.flatnonzero(check.take(child) == node)
                if not on.size:
                    break
                who, node = who.take(on), child.take(on)
                found.append((k, who, ended.take(node)))
            here = np.full(n, -1)
            for k, who, token in reversed(found):  # the longest first
                open_ = np.flatnonzero((token >= 0) & (here.take(who) < 0))
                who, token = who.take(open_), token.take(open_).astype(np.int64)
                fit = self._fit(last[i - k].take(who), token)
                here[who[fit]] = token[fit]
            if n and here.min() < 0:
                raise ValueError("the vocabulary lacks a byte")
            last.append(here)
        rows, last = np.cumsum([0, *going]), np.concatenate(last)
        at, who, back, counts = lengths.copy(), np.arange(len(words)), [], np.zeros(len(words), np.int64)
        while who.size:
            token = last[rows[at[who]] + who]
            back.append((who, token))
            counts[who] += 1
            at[who] -= self.sizes[token]
            who = who[at[who] > 0]
        ends = np.cumsum(counts)
        ids, place = np.empty(ends[-1], "<u4"), ends - 1
        for who, token in back:
            ids[place[who]] = token
            place[who] -= 1
        ids, found = ids.tobytes(), [b""] * len(words)
        for k, lo, hi in zip(order.tolist(), (4 * (ends - counts)).tolist(), (4 * ends).tolist()):
            found[k] = ids[lo:hi]
        return found

    def pretokens(self, pretokens: list[str]) -> list[bytes]:
        """What `pretoken` gives for each; short ones go abreast."""
        texts = list(map(str.encode, pretokens))
        known = self.vocabulary.by_bytes
        short = [k for k, text in enumerate(texts) if len(text) <= ABREAST and text not in known]
        found = [b""] * len(texts)
        if short:
            for k, ids in zip(short, self._abreast([texts[k] for k in short])):
                found[k] = ids
        return [ids or self.pretoken(pretoken) for ids, pretoken in zip(found, pretokens)]

    def pretoken(self, pretoken: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = pretoken.encode()
        token = self.vocabulary.by_bytes.get(text)
        if token is not None:
            return struct.pack("<I", token)
        if len(text) <= 2 * self.lookahead:  # it ends before anything is emitted
            path = self._path(text, [-1, *itertools.repeat(None, len(text))], len(text))
            return struct.pack(f"<{len(path)}I", *path)
        blocks = (text[i : i + WINDOW] for i in range(0, len(text), WINDOW))
        return b"".join(struct.pack(f"<{len(part)}I", *part) for part in self.stream(blocks))

    def stream(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of the bytes that come in blocks: what is kept is less than three times the lookahead."""
        kept, last = b"", [-1]
        for block in blocks:
            for at in range(0, len(block), self.lookahead):
                more = block[at : at + self.lookahead]
                kept += more
                last += [None] * len(more)
                if len(kept) > 2 * self.lookahead:
                    stable = self._agreed(kept, last)
                    if stable:
                        yield self._path(kept, last, stable)
                        kept, last = kept[stable:], last[stable:]
        if kept:
            yield self._path(kept, last, len(kept))

    def _agreed(self, kept: bytes, last: list[int | None]) -> int:
        """The farthest position through which the paths of all open positions go."""
        size = self.vocabulary.sizes
        open_ends = set(range(len(kept) + 1 - self.lookahead, len(kept) + 1))
        while len(open_ends) > 1:
            top = max(open_ends)
            open_ends.remove(top)
            open_ends.add(top - size[self._last(kept, top, last)] if top else 0)
        return open_ends.pop()

    def _path(self, kept: bytes, last: list[int | None], end: int) -> list[int]:
        size, back = self.vocabulary.sizes, []
        while end > 0:
            token = self._last(kept, end, last)
            back.append(token)
            end -= size[token]
        return back[::-1]


class _Known(dict):
    """Remembers what `work` made of texts; of the REMEMBERED texts or more, those asked for of late."""

    def __init__(self, work: Callable[[list[str]], list[bytes]]):
        super().__init__()
        self.work, self.before = work, {}

    def all(self, texts: list[str]) -> list[bytes]:
        """What is made of these texts, each given once."""
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        found = list(map(self.get, texts))
        new = [k for k, x in enumerate(found) if x is None]
        for k in new:
            found[k] = self.before.get(texts[k])
        missing = [k for k in new if found[k] is None]
        for k, x in zip(missing, self.work([texts[k] for k in missing])):
            found[k] = x
        self.update((texts[k], found[k]) for k in new if len(texts[k]) <= 64)
        return found


def _laid(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """One after another, for each number k in `which`, the sizes[k] values from begins[k] on."""
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    return values[np.repeat(begins[which] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes and decodes whole texts in windows."""

    def __init__(self, source: str | dict):
        self.vocabulary = Vocabulary(source)
        self.transducer = Transducer(self.vocabulary)
        # nothing refers back to the codec: its memory is free as soon as its task ends
        pretokens, split = _Known(self.transducer.pretokens), regex.compile(SPLIT).findall

        def of_keys(keys: list[str]) -> list[bytes]:
            chunks = [x[1:] if x[:1] == BARE else " " + x for x in keys]
            # letters of ASCII after a space are one pretoken
            parts = [chunk if key.isalpha() and key.isascii() else split(chunk) for key, chunk in zip(keys, chunks)]
            different = list({x for part in parts for x in ((part,) if isinstance(part, str) else part)})
            known = dict(zip(different, pretokens.all(different)))
            return [known[x] if isinstance(x, str) else b"".join(map(known.__getitem__, x)) for x in parts]

        self.chunks = _Known(of_keys)
        sizes = np.array(self.vocabulary.sizes)
        self.said = np.frombuffer(b"".join(self.vocabulary.bytes), np.uint8), np.cumsum(sizes) - sizes, sizes
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.safe = regex.compile(r"(?<=[^\s]) (?=[^\s])")
        self.border = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])")

    def windows(self, text: str) -> Iterator[str]:
        """Parts between which no pretoken lies, of about WINDOW characters but where there is no place to cut."""
        at = 0
        while len(text) - at > WINDOW:
            cut = self.border.search(text, at + WINDOW, min(len(text), at + 2 * WINDOW))
            if not cut and not (cut := self.border.search(text, at + WINDOW)):
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def keys_of(self, window: str) -> list[str]:
        """Keys of the parts of the window, cut at the single spaces between other characters; other spaces stay inside a part.

        A part is a space and its key, or what comes after BARE in its key.
        """
        cuts = [0, *(m.start() for m in self.safe.finditer(window)), len(window)]
        chunks = [window[a:b] for a, b in itertools.pairwise(cuts) if a < b]
        return [x[1:] if x[0] == " " and x[1:2] != BARE else BARE + x for x in chunks]

    def encode(self, text: str) -> Iterator[bytes]:
        """Token ids, as little-endian 32-bit integers, window by window."""
        return (ids for _, ids in self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """The token ids of texts, window by window, each with its text's place; empty texts have one window."""
        block, held = [], 0
        for place, text in enumerate(texts):
            for part in self.added.split(text) if self.added and text else [text]:
                added = self.vocabulary.added.get(part)
                for window in self.windows(part) if part or not text else ():
                    block.append((place, window if added is None else struct.pack("<I", added)))
                    held += len(window)
                    if held >= BLOCK:
                        yield from self._encoded(block)
                        block, held = [], 0
        yield from self._encoded(block)

    def _encoded(self, block: list[tuple[int, str | bytes]]) -> Iterator[tuple[int, bytes]]:
        windows = [x for _, x in block if isinstance(x, str) and x]
        odd = pc.match_substring_regex(pa.array(windows, pa.string()), ODD).to_pylist()
        # windows without odd spaces are cut by Arrow; of both kinds, the keys and how many each window has
        plain = pc.split_pattern(pa.array([x[1:] if x[0] == " " else BARE + x for x, o in zip(windows, odd) if not o], pa.string()), " ")
        other = [self.keys_of(x) for x, o in zip(windows, odd) if o]
        keys = pa.concat_arrays([plain.flatten(), pa.array(list(itertools.chain.from_iterable(other)), pa.string())]).dictionary_encode()
        counts = pc.list_value_length(plain).to_pylist(), list(map(len, other))
        ids, which = self.chunks.all(keys.dictionary.to_pylist()), keys.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ids = _laid(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes, which)
        borders = np.cumsum([0, *counts[0], *counts[1]])
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[borders].tolist()
        # the windows of each kind in turn
        kinds, at = iter(odd), [0, len(counts[0])]
        for place, x in block:
            if isinstance(x, str) and x:
                kind = next(kinds)
                x = ids[ends[at[kind]] : ends[at[kind] + 1]].tobytes()
                at[kind] += 1
            yield place, x or b""

    def decode(self, ids: Iterator[np.ndarray]) -> Iterator[str]:
        """The text of a stream of ids; bytes that end inside a character wait for the next ids."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for part in ids:
            for at in range(0, len(part), WINDOW):
                yield state.decode(_laid(*self.said, part[at : at + WINDOW]).tobytes())
        yield state.decode(b"", True)


def _shared(rows: DataFrame, path: str):
    """The vocabulary for executors, which the driver alone reads; a worker keeps it from task to task."""
    return rows.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))


def _by_text(encoded: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    return itertools.groupby(encoded, operator.itemgetter(0))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """All columns of docs and `out`: array<int>, the token ids of `text`, in place of a column of that name."""
    docs = docs.drop(out)
    schema = f"{ddl(docs)}, `{out}` array<int>" if docs.columns else f"`{out}` array<int>"

    shared = _shared(docs, path)

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo in range(0, len(column), 256):
                texts = column.slice(lo, 256).to_pylist()
                ids = [b"".join(ids for _, ids in parts) for _, parts in _by_text(codec.encode_all(x or "" for x in texts))]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), values)], names=[*part.schema.names, out])

    return map_texts(docs, run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """All columns and `out`: the text of `ids` (null: empty), in place of a column of that name."""
    tokens = tokens.drop(out)
    schema = f"{ddl(tokens)}, `{out}` string"

    shared = _shared(tokens, path)

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = ["".join(codec.decode([np.array(x or [], np.int64)])) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return map_texts(tokens, run, schema)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids_column: str | None = None) -> DataFrame:
    """The columns `keep` (all but the text, by default), n_tokens, ids_sha256 and decoded_sha256.

    The digests are of an encoding and of its decoding, which are held only in part. With
    `ids_column`, the token ids are returned too, as array<int> of that name.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *([ids_column] if ids_column else [])]
    keep = without([c for c in docs.columns if c != text] if keep is None else keep, results)
    docs, kept = with_text(docs, keep, text)
    names = [*keep, *results]
    schema = f"{kept}n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (f", `{ids_column}` array<int>" if ids_column else "")

    shared = _shared(docs, path)

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows, ends, kept_ids = [], [0], []
                for _, parts in _by_text(codec.encode_all(x.as_py() or "" for x in part.column(len(keep)))):
                    of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0

                    def ids(parts=parts, of_ids=of_ids):
                        nonlocal n
                        for _, some in parts:
                            of_ids.update(some)
                            n += len(some) // 4
                            if ids_column:
                                kept_ids.append(some)
                            yield np.frombuffer(some, "<u4")

                    for some in codec.decode(ids()):
                        of_text.update(some.encode())
                    rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
                    ends.append(ends[-1] + n)
                counts, first, second = zip(*rows)
                arrays = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                if ids_column:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(kept_ids), "<i4"))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *arrays], names=names)

    return map_texts(docs, run, schema)
