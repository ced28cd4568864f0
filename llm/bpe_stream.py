"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Encoding.  For every prefix of a word there is one token that ends its encoding;
``_ends`` finds it from the ends of shorter prefixes, because a sequence of
tokens is an encoding exactly when each adjacent pair is one.  No token is longer
than ``lookahead`` symbols, so each future prefix hangs on a prefix that ends
within the last ``lookahead`` symbols.  Tokens that the chains of all of these
share can never change: they are stable and emitted, and their symbols are
forgotten.  The merge list alone bounds how long chains can disagree: a merge
can hand an influence on by one token at most, so ``sufficient``, merges x longest
token symbols, is a lookahead that always settles, and no more than that is ever
held.

A pair (a, b) is an encoding unless some merge across its border applies while
both of its operands are at the border; ``_apart`` walks the two spines of the
merge trees in the order of the merges.

A text goes through in chunks of CHUNK bytes cut at white space; a longer piece
without any goes through the transducer symbol by symbol.  The ids of a chunk are
hashed, decoded and forgotten, so nothing but the row itself grows with a text
(with ``keep_ids`` its ids, which are the result).

Decoding.  ``TextDecoder`` is the byte-to-text machine: ids come in any pieces,
an unfinished UTF-8 sequence waits for its other bytes, and broken ones become
U+FFFD; its text is the column text_sha256.  ``NameDecoder`` gives the text as a
tokenizer without a decoder does, tokens with a space between: decoded_sha256.

Edge cases: a null text is an empty one, with no ids and an empty decoded text;
special tokens found in a text are their own ids.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bytewords import texts_of
from .store import table
from .token_memo import PieceMemo, byte_alphabet, lowered, plain_word

#: Bytes of a text encoded at a time.
CHUNK = 1 << 16
#: Symbols read between two looks for stable tokens.
STEP = 256
#: Pairs whose adjacency is remembered.
PAIR_MEMO = 100_000
_NEVER = 1 << 60
_SPACE = re.compile(rb"[ \t-\r]")


class Transducer:
    """Streaming encoder of a vocabulary file with merges and a suffix at word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.chars = str.maketrans(dict(enumerate(byte_alphabet())))
        #: id pair -> order of its merge; token -> (order, left, right) of the merge that makes it
        self.merges: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for order, (left, right) in enumerate(model["merges"]):
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merges.setdefault((a, b), order)
            self.made.setdefault(c, (order, a, b))
        width = lambda t: len(t.removesuffix(self.suffix)) if t != self.suffix else 1
        #: longest token in symbols
        self.lookahead = max(map(width, self.vocab))
        #: symbols after which a token is surely stable
        self.sufficient = len(self.merges) * self.lookahead
        self.pairs: dict[int, bool] = {}
        #: tokens by their symbols from last to first; the id stands under the key ""
        self.inner: dict = {}
        self.final: dict = {}
        for t, i in self.vocab.items():
            if self._whole(i):
                ended = bool(self.suffix) and t.endswith(self.suffix) and t != self.suffix
                node = self.final if ended else self.inner
                for c in reversed(t.removesuffix(self.suffix) if ended else t):
                    node = node.setdefault(c, {})
                node[""] = i
        if not self.suffix:
            self.final = self.inner

    def _apart(self, a: int, b: int) -> bool:
        """Whether a, b are the encoding of their joined symbols."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        made, merges = self.made, self.merges
        left, right = [(a, _NEVER)], [(b, _NEVER)]  # (token at the border, order of the merge that takes it in)
        while (m := made.get(left[-1][0])) is not None:
            left.append((m[2], m[0]))
        while (m := made.get(right[-1][0])) is not None:
            right.append((m[1], m[0]))
        i, j, apart = len(left) - 1, len(right) - 1, True
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            order = merges.get((x, y))
            # Of equal orders the leftmost applies first: before x's own merge ends at the border, after y's begins there.
            if order is not None and order < x_end and order <= y_end:
                apart = False
                break
            if x_end == _NEVER and y_end == _NEVER:
                break
            if x_end <= y_end:
                i -= 1
            else:
                j -= 1
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        self.pairs[key] = apart
        return apart

    def word(self, symbols: Iterable[str]) -> Iterator[int]:
        """ids of one word that comes in any pieces; only the symbols that are not emitted yet are kept."""
        tail, ends, due = "", [(0, -1)], STEP
        for chunk in symbols:
            tail += chunk
            # The last symbol stays back: it may be the word's last one, which carries the suffix.
            while len(ends) < len(tail):
                self._ends(tail, min(len(tail) - 1, due), ends)
                if len(ends) <= due:
                    break
                cut, ids = self._stable(ends)
                yield from ids
                if len(ends) - cut > self.sufficient + STEP:
                    raise ValueError("the merge list settles nothing within its sufficient lookahead")
                if cut:
                    tail, ends = tail[cut:], [(0, ids[-1]), *ends[cut + 1 :]]
                due = len(ends) + STEP
        if tail:
            self._ends(tail, len(tail) - 1, ends)
            yield from self._chain([*ends, self._end(tail, len(tail), ends, self.final)], len(tail))

    def _ends(self, text: str, upto: int, ends: list[tuple[int, int]]) -> None:
        """Appends (length, id) of the token that ends each prefix of ``text`` up to ``upto``."""
        for i in range(len(ends), upto + 1):
            ends.append(self._end(text, i, ends, self.inner))

    def _end(self, text: str, i: int, ends: list[tuple[int, int]], node: dict) -> tuple[int, int]:
        pairs = self.pairs
        for j in range(i - 1, -1, -1):
            node = node.get(text[j])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                before = ends[j][1]
                if before < 0:
                    return i - j, token
                apart = pairs.get(before << 32 | token)
                if apart or apart is None and self._apart(before, token):
                    return i - j, token
        raise ValueError(f"no token for {text[i - 1 : i]!r}")

    def _whole(self, token: int) -> bool:
        """Whether a token is the encoding of its own symbols: the first merge across each border in it is its own."""
        m = self.made.get(token)
        return m is None or (self._whole(m[1]) and self._whole(m[2]) and self._apart_but(m[1], m[2], m[0]))

    def _apart_but(self, a: int, b: int, order: int) -> bool:
        """Whether the first merge across the border of a, b is that of a and b themselves."""
        made, merges = self.made, self.merges
        left, right = [(a, _NEVER)], [(b, _NEVER)]
        while (m := made.get(left[-1][0])) is not None:
            left.append((m[2], m[0]))
        while (m := made.get(right[-1][0])) is not None:
            right.append((m[1], m[0]))
        i, j = len(left) - 1, len(right) - 1
        while i or j:
            (x, x_end), (y, y_end) = left[i], right[j]
            across = merges.get((x, y))
            if across is not None and across < x_end and across <= y_end:
                return False
            if x_end <= y_end:
                i -= 1
            else:
                j -= 1
        return merges.get((a, b)) == order

    @staticmethod
    def _chain(ends: list[tuple[int, int]], i: int) -> list[int]:
        ids = []
        while i > 0:
            length, token = ends[i]
            ids.append(token)
            i -= length
        return ids[::-1]

    def _stable(self, ends: list[tuple[int, int]]) -> tuple[int, list[int]]:
        """The last border that the chains of all recent prefixes share, and the ids before it."""
        live = set(range(max(0, len(ends) - self.lookahead), len(ends)))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - ends[far][0] if far else 0)
        (cut,) = live
        return cut, self._chain(ends, cut)

    def pieces(self, text: str) -> Iterator[int]:
        """ids of a text without a memory of pieces."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield self.specials[part]
                continue
            part = lowered(regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part)))
            for word in self.splitter.finditer(part):
                yield from self.word(self._symbols(word[0]))

    def _symbols(self, word: str) -> Iterator[str]:
        for i in range(0, len(word), 4 * STEP):
            yield word[i : i + 4 * STEP].encode().decode("latin-1").translate(self.chars)

    def encode_piece(self, piece: bytes) -> list[int]:
        word = plain_word(piece)
        if word is not None:
            return list(self.word(self._symbols(word)))
        return list(self.pieces(piece.decode(errors="replace")))


class TextDecoder:
    """Incremental byte-to-text machine for byte-level tokens; the word suffix is a space."""

    def __init__(self, coder: Transducer) -> None:
        byte, suffix = {c: b for b, c in enumerate(byte_alphabet())}, coder.suffix
        self.bytes = {i: name.encode() for name, i in coder.specials.items()}
        for i, name in coder.names.items():
            ended = bool(suffix) and name.endswith(suffix)
            self.bytes.setdefault(i, bytes(byte[c] for c in (name.removesuffix(suffix) if ended else name)) + b" " * ended)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        """What was left unfinished; the machine is as new after it."""
        rest = self.machine.decode(b"", True)
        self.machine.reset()
        return rest


class NameDecoder:
    """The decoded text of a tokenizer without a decoder, in pieces of UTF-8."""

    def __init__(self, coder: Transducer) -> None:
        self.names = {i: name.encode() for i, name in coder.names.items()}
        self.begun = False

    def feed(self, ids: list[int]) -> bytes:
        before = b" " if self.begun and ids else b""
        self.begun |= bool(ids)
        return before + b" ".join(map(self.names.__getitem__, ids))

    def finish(self) -> None:
        self.begun = False


class Coder:
    """Encoder and decoders of a vocabulary file with a bounded memory of pieces."""

    def __init__(self, path: str) -> None:
        self.transducer = Transducer(path)
        self.dtype = np.uint16 if max(self.transducer.names) < 1 << 16 else np.uint32
        self.memo = PieceMemo(self.transducer.encode_piece, self.dtype)
        self.text, self.names = TextDecoder(self.transducer), NameDecoder(self.transducer)

    def blocks(self, text: bytes) -> Iterator[np.ndarray]:
        """The ids of a text, chunk by chunk."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                cut = max(text.rfind(c, at + CHUNK // 2, at + CHUNK) for c in (b" ", b"\n"))
                space = _SPACE.search(text, at + CHUNK) if cut < 0 else None
                end = cut + 1 if cut >= 0 else space.end() if space else end
            if end - at <= 2 * CHUNK:
                yield np.frombuffer(self.memo.ids(text[at:end]), self.dtype)
            else:
                for piece in text[at:end].split():
                    ids = self.transducer.pieces(piece.decode(errors="replace"))
                    while len(some := np.fromiter(islice(ids, CHUNK), self.dtype)):
                        yield some
            at = end

    def round_trip(self, text: bytes, keep_ids: bool) -> tuple[int, str, str, str, bytes | None]:
        """Number of ids, digests of ids, of the decoded text as the library gives it and as plain text, and the ids."""
        count, kept = 0, []
        ids_digest, names_digest, text_digest = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        for block in self.blocks(text):
            raw, ids = block.astype("<u4").tobytes(), block.tolist()
            count += len(ids)
            ids_digest.update(raw)
            names_digest.update(self.names.feed(ids))
            text_digest.update(self.text.feed(ids).encode())
            if keep_ids:
                kept.append(raw)
        text_digest.update(self.text.finish().encode())
        self.names.finish()
        return count, ids_digest.hexdigest(), names_digest.hexdigest(), text_digest.hexdigest(), b"".join(kept) if keep_ids else None


@lru_cache(maxsize=2)
def coder_of(path: str) -> Coder:
    return Coder(path)


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"


def _round_trip(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: 5 if keep_ids else 4]
        names = [f.split()[0] for f in RESULT.split(", ")] + ["ids"] * keep_ids
        for batch in batches:
            rows = [coder.round_trip(text.as_py(), keep_ids) for text in texts_of(batch.column("text")).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)

    return run


def bpe_round_trip(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256, and with ``keep_ids`` the ids as 32-bit integers."""
    schema = RESULT + ", ids binary" * keep_ids
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_round_trip(tokenizer, keep_ids), schema)


def op6_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
