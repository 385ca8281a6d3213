"""Token ids of whole texts, with a per-worker memory of what is already encoded.

The byte-level vocabulary cuts a text at a single space between two characters
that are no white space, whatever stands around it, so the parts between such
spaces can be encoded one by one and remembered.  A batch is split and reduced to
its distinct parts by Arrow, and its ids are gathered by numpy.  A new part of
simple characters is cut into pieces by the vocabulary's published pattern, and
each new piece goes once through the library's merges; other new parts are
encoded together by the library's whole call and told apart by the space that
each begins with.  A text that holds the string of an added token, such as
``<|endoftext|>``, is encoded whole, as the library takes that string as one id
and an added token may hold or take in spaces.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
#: Parts, and pieces of parts, remembered per worker in each of two generations (some 220 bytes each), and the longest of them.
REMEMBERED = 400_000
REMEMBERED_PIECES = 400_000
LONGEST = 48
#: New parts that are encoded in one call.
CALL_PARTS = 4096

# Fixed value: the byte-level vocabulary's pattern, letters and digits written out for the simple characters.
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "| ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
    "| ?[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+"
    "| ?[^\\sA-Za-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
    "|\\s+(?!\\S)|\\s+"
)
#: Characters whose kinds are the same in every version of Unicode; line feed and space are their only white space.
_SIMPLE = re.compile("[\n -~\u00a1-\u024f]*")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary_path(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(BYTE_BPE)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids of pieces as bytes, merged by the library's model when first asked for, in two generations."""

    def __init__(self, model):
        super().__init__()
        self.model, self.old = model, {}
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # pieces are remembered here, so the model's own memory is only a cost
        self.packed = functools.cache(lambda n: struct.Struct(f"<{n}I"))
        self.spelled = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():
                spelled = piece.replace(" ", "\u0120")
            else:
                spelled = piece.encode().decode("latin-1").translate(self.spelled)
            ids = self.packed(len(got := self.model.tokenize(spelled))).pack(*[t.id for t in got])
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > REMEMBERED_PIECES:
            self.old = {}  # let go of the oldest before the others are copied
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = REMEMBERED
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces = Pieces(self.tokenizer.model)
        cut = self.tokenizer.pre_tokenizer
        self.cuts_known = self.tokenizer.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True  # how byte-level names spell a space

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _one(self, text: str) -> bytes:
        """Ids of a text that begins a document or a part, without remembering it."""
        if self.cuts_known and _SIMPLE.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))
        return self._plain(text)

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that follow a space and neither start nor end with white space."""
        ids, cut, simple, out, rest = self.pieces.__getitem__, _PIECE.findall, _SIMPLE.fullmatch, {}, []
        for p in parts:
            if self.cuts_known and simple(p):
                out[p] = b"".join(map(ids, cut(" " + p)))
            else:
                rest.append(p)
        for at in range(0, len(rest), CALL_PARTS):
            some = rest[at : at + CALL_PARTS]
            code = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0]
            got = np.array(code.ids, dtype="<u4")
            # a part holds one space, its first character, so the ids that begin with a space are its starts
            begins = np.flatnonzero(self.spaced[got])
            stops = (4 * np.append(begins[1:], len(got))).tolist()
            raw = got.tobytes()
            out.update(zip(some, map(raw.__getitem__, map(slice, [0] + stops, stops))))
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, from memory where it has them; the long ones are not remembered."""
        if len(self.new) > self.remembered:
            self.old, self.new = self.new, {}
        self.pieces.age()
        new, old = self.new, self.old
        out = list(map(new.get, parts))
        missing = [k for k, ids in enumerate(out) if ids is None]
        fresh = self._parts([p for k in missing if (p := parts[k]) not in old])
        for k in missing:
            p = parts[k]
            out[k] = ids = fresh[p] if p in fresh else old[p]
            if len(p) <= LONGEST:
                new[p] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, those of the tokenizer's plain call."""
        whole = [any(a in t for a in self.added) for t in texts]
        if any(whole):
            rest = iter(self.encode([t for t, w in zip(texts, whole) if not w]))
            return [self._plain(t) if w else next(rest) for t, w in zip(texts, whole)]
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        kinds, at = coded.indices.to_numpy(), split.offsets.to_numpy()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = np.array([p != p.strip() or not p for p in parts], bool)
        first = np.array([not t or t[0] == " " or t.partition(" ")[0][-1].isspace() for t in texts])
        bad = np.append(0, np.cumsum(odd[kinds]))
        careful = first | (bad[at[1:]] > bad[np.minimum(at[:-1] + 1, at[1:])])
        kept = np.flatnonzero(~odd)
        held = self._known([parts[k] for k in kept.tolist()])
        sizes = np.zeros(len(parts), np.int64)
        sizes[kept] = np.fromiter(map(len, held), np.int64, len(held)) // 4
        pool, begins = np.frombuffer(b"".join(held), "<u4"), np.cumsum(sizes) - sizes
        # the first part of a text follows no space, so its ids are asked for apart
        counts = sizes[kinds]
        counts[at[:-1]] = 0
        ends = np.cumsum(counts)
        source = np.repeat(begins[kinds] - (ends - counts), counts)
        source += np.arange(len(source))
        raw, stops = pool[source].tobytes(), (4 * ends[at[1:] - 1]).tolist()
        return [
            self._careful(t) if c else self._one(t.partition(" ")[0]) + raw[a:b]
            for t, c, a, b in zip(texts, careful.tolist(), [0] + stops, stops)
        ]

    def _careful(self, text: str) -> bytes:
        if not text:
            return b""
        parts = _CUT.split(text)
        known = self._parts(list({p for p in parts[1:] if len(p) <= LONGEST and " " not in p and not p[0].isspace() and not p[-1].isspace()}))
        return self._plain(parts[0]) + b"".join(known[p] if p in known else self._plain(" " + p) for p in parts[1:])


def encoder(path: str | None = None) -> Encoder:
    path = vocabulary_path(path)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Free what this worker remembers; for later stages, whose tasks run in the same workers and encode nothing."""
    _ENCODERS.clear()


def encode_slices(texts, path: str | None = None, remembered: int = REMEMBERED, chars: int = 1 << 21):
    """Ids of the texts in order, about two million characters at a time."""
    coder, held, size = encoder(path), [], 0
    coder.remembered = remembered
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= chars:
            yield from coder.encode(held)
            held, size = [], 0
    yield from coder.encode(held)
