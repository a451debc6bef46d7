"""Token ids of whole texts by a public tokenizer, exactly as the library gives them.

Words repeat, so the ids of a word are kept, known by a 64-bit hash of its bytes;
signs that end a word are kept apart from it where the pre-tokenizers cut there.
Texts are cut at single blanks and line ends only, where the pre-tokenizers
always cut whatever stands around; a text with white space of any other shape
goes to the library whole. Both ways give the same ids (tested).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from corpusloom.llm.hashing import BUFFER, LOWER, WHITE, give_back, hashes, mixed, runs, wide_white, words_in

#: words kept per worker process, and parts of words that the library is asked for: all go when there are so many
KEPT_WORDS, KEPT_PARTS = 200_000, 50_000
#: signs that end a word; no apostrophe, which may begin a pre-token, and nothing of a special token's name
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


_TAIL = np.zeros(256, bool)
_TAIL[list(TAIL.encode())] = True
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
#: letters before this are composed and lower-cased one by one
PLAIN = "\u0250"


def byte_alphabet() -> list[str]:
    """The byte-level scheme's sign for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Words(dict):
    """word to the ids of ``before + word``, for parts of words; ``of`` gives a whole word's."""

    def __init__(self, tokenizer, before: str, lowers: bool) -> None:
        super().__init__()
        self.tokenizer, self.before, self.lowers = tokenizer, before, lowers
        self.tails: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_PARTS:
            self.clear()
        self[word] = found = self.of(word)
        return found

    def of(self, word: str) -> bytes:
        core = word.rstrip(TAIL)
        if core != word and core and core[-1] < PLAIN and core[-1].lower().isalpha():
            # pre-tokenizers cut between a plain letter and such signs; any other letter may end in a mark that joins them once it is normalised
            return self[core] + self.tail(word[len(core) :])
        if word.isalpha() and max(word) < PLAIN:
            low = word.lower() if self.lowers else word
            if low == word:
                return self.letters(word)
            if len(low) == len(word) and max(low) < PLAIN:
                return self[low]
        return self.ids(self.before + word)

    def letters(self, word: str) -> bytes:
        """A word of plain letters is one pre-token: straight to the model, in its byte alphabet."""
        known = self.before + word
        spelled = known if self.before == "" and word.isascii() else "".join(map(self.alphabet.__getitem__, known.encode()))
        return np.asarray([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def tail(self, signs: str) -> bytes:
        if signs not in self.tails:
            if len(self.tails) >= 10_000:
                self.tails.clear()
            self.tails[signs] = self.ids(signs)
        return self.tails[signs]

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Encoder:
    """kind 'byte': a word takes the blank before it and a line end stands alone; 'word': white space is dropped."""

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.first = Words(self.tokenizer, "", kind == "word")
        self.later = Words(self.tokenizer, " ", False) if kind == "byte" else self.first
        self.line_end = np.frombuffer(self.first.ids("\n"), "<u4") if kind == "byte" else np.zeros(0, "<u4")
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """The ids of known words stand one after the other; a line end's are the first."""
        self.known: dict[int, int] = {}
        self.pool, self.used = self.line_end.copy(), len(self.line_end)
        # where each word's ids begin, and behind them where the next word's do
        self.starts, self.n = np.array([0, self.used], np.int32), 1

    def _learn(self, keys: np.ndarray, words: list[tuple[bytes, bool]]) -> None:
        found = [(self.later if blank else self.first).of(w.decode("utf-8", "replace")) for w, blank in words]
        added = np.frombuffer(b"".join(found), "<u4")
        if self.used + len(added) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 2 + 2 * len(added), "<u4")])
        self.pool[self.used : self.used + len(added)] = added
        if self.n + len(found) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts[: self.n + 1], np.zeros(self.n // 2 + 2 * len(found), np.int32)])
        self.starts[self.n + 1 : self.n + 1 + len(found)] = self.used + np.cumsum([len(own) // 4 for own in found])
        self.known.update(zip(keys.tolist(), range(self.n, self.n + len(found)), strict=True))
        self.used, self.n = self.used + len(added), self.n + len(found)

    def _odd(self, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which texts hold white space of another shape."""
        white = np.flatnonzero(buf <= 32)
        white = white[WHITE[buf[white]]]
        kind = buf[white]
        strange = [white[(kind != 32) & (kind != 10)], wide_white(buf)]
        if self.kind == "byte":
            # white space that begins or ends a text or follows other white space; each text ends in a line end of our own
            inside = np.zeros(len(buf) + 1, bool)
            inside[white] = True
            begin = np.concatenate([[0], ends[:-1]])
            last = np.isin(white, ends - 1)
            strange += [white[inside[white + 1] & ~last], begin[inside[begin] & (begin != ends - 1)]]
        out = np.zeros(len(ends), bool)
        out[np.searchsorted(ends, np.concatenate(strange), side="right")] = True
        return out

    def _parts(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, whether it is the beginning of a word) of words without the signs that end them, and of these signs, in order.

        Only where a plain letter comes before: of ASCII, or the Latin letters with two bytes of which the first is C3 to C5, but for the dotted capital I, whose lower case ends in a mark."""
        end, todo = last.copy(), np.arange(len(first))
        while len(todo):
            todo = todo[end[todo] > first[todo]]
            todo = todo[_TAIL[buf[end[todo] - 1]]]
            end[todo] -= 1
        cut = np.flatnonzero((end < last) & (end > first))
        a, b = buf[end[cut] - 1], buf[np.maximum(end[cut] - 2, 0)]
        two = (a >= 0x80) & (a < 0xC0) & (b >= 0xC3) & (b <= 0xC5) & (end[cut] - 2 >= first[cut]) & ~((b == 0xC3) & ((a == 0x97) | (a == 0xB7))) & ~((b == 0xC4) & (a == 0xB0))
        cut = cut[_ASCII[a] | two]
        pieces = np.ones(len(first), np.int64)
        pieces[cut] = 2
        at = np.cumsum(pieces) - pieces
        begins, ends, whole = np.repeat(first, pieces), np.repeat(last, pieces), np.ones(int(pieces.sum()), bool)
        ends[at[cut]] = begins[at[cut] + 1] = end[cut]
        whole[at[cut] + 1] = False
        return begins, ends, whole

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        odd = self._odd(buf, ends)
        first, last, whole = self._parts(buf, *words_in(buf, WHITE, wide=True))
        if self.kind == "word":
            # the normaliser lowers these letters anyway; only the library's own tokens are found before it
            low = LOWER[buf]
            data = low.tobytes()
            buf = buf if any(t in data for t in self.special) else low
        key = hashes(buf, first, last)
        blank = np.zeros(len(first), bool)
        if self.kind == "byte":
            blank = whole & (buf[first - 1] == 32) & (first > 0)
            key = np.where(blank, mixed(key, 1), key)
        if len(self.known) > KEPT_WORDS:
            self._forget()
        order = np.argsort(key)
        new = np.diff(key[order], prepend=~key[order[:1]]) != 0
        unique, example = key[order][new], order[new]
        number = np.fromiter((self.known.get(k, -1) for k in unique.tolist()), np.int64, len(unique))
        absent = np.flatnonzero(number < 0)
        if len(absent):
            at = example[absent]
            data = buf.tobytes()
            number[absent] = self.n + np.arange(len(absent))
            self._learn(unique[absent], [(data[a:b], c) for a, b, c in zip(first[at].tolist(), last[at].tolist(), blank[at].tolist(), strict=True)])
        item = np.empty(len(first), np.int64)
        item[order] = number[np.cumsum(new) - 1]
        place = first
        if len(self.line_end):
            lines = np.flatnonzero(buf == 10)
            lines = lines[~np.isin(lines, ends - 1)]
            by = np.argsort(np.concatenate([first, lines]), kind="stable")
            place, item = np.concatenate([first, lines])[by], np.concatenate([item, np.zeros(len(lines), np.int64)])[by]
        begin = self.starts[item].astype(np.int64)
        sizes = self.starts[item + 1] - begin
        flat = runs(self.pool, begin, sizes)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(place, ends)]
        at = 0
        for i, (cut, strange) in enumerate(zip(cuts.tolist(), odd.tolist(), strict=True)):
            yield np.frombuffer(self.first.ids(texts[i].decode("utf-8", "replace")), "<u4") if strange else flat[at:cut]
            at = cut

    def arrays(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text in UTF-8 as unsigned 32-bit integers; null: none."""
        held, size = [], 0
        for t in texts:
            held.append(t or b"")
            size += len(held[-1]) + 1
            if size >= BUFFER:
                yield from self._block(held)
                held, size = [], 0
        if held:
            yield from self._block(held)
        del held
        give_back()

    def one(self, text: str) -> bytes:
        return next(self.arrays([text.encode("utf-8", "surrogatepass")])).tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null: none."""
        return (x.tobytes() for x in self.arrays(None if t is None else t.encode("utf-8", "surrogatepass") for t in texts))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
