"""Secret scan: candidate strings, judged by a random forest.

A candidate is
* a run of at least LEAST characters of letters, digits and ``+/_-`` (with ``=``
  at its end) that has a digit or mixed case, also several of them with points
  between after ``eyJ`` (signed tokens),
* what is assigned to a word such as ``token`` or ``password``: a quoted value of
  any characters, or an unspaced one, from KEYED_LEAST characters on,
* the password of an address, ``scheme://user:password@host``,
* the body of a block that begins as a private key.
Of overlapping secrets the longest is the finding.  The forest looks at its length, the transitions
between kinds of characters, its entropy, how much of it dictionary words cover,
whether it is part of a path or address, and the words next to it.  It is
trained on labelled findings: ``fit`` takes any, ``labelled_findings`` makes a
seeded set of true secrets and of common false positives (digests, identifiers,
paths, numbers, placeholders).

Edge cases: a null or empty text has no findings; equal secrets at several places
are several findings; texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import texts_of
from .store import table

LEAST, NEAR, THRESHOLD, MASK = 16, 48, 0.5, "<secret>"
TREES, DEPTH, LEAF_ROWS, SEED, FINDINGS = 30, 8, 4, 7, 6_000
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
KEYED_LEAST = 6
_KEY = r"(?i:(?:password|passwd|passphrase|pwd|secret|token|credential|api[_-]?key)s?|(?<![a-z])(?:key|auth|pass|passcode|login|bearer))(?:[0-9]+|[_-][A-Za-z0-9_-]{0,20}|Key|Value|Id)?"
_SETS = r"[\"'`]?(?:[ \t]{0,4}(?::=|=>|==?|:)[ \t]{0,4}|[ \t]{1,4}(?i:is):?[ \t]{1,4})"
_ASSIGNED = re.compile(rf"{_KEY}{_SETS}(?:([\"'`])((?:\\.|(?!\1)[^\\\n]){{{KEYED_LEAST},}})\1|([^\s\"'`]{{{KEYED_LEAST},}}))")
_BEFORE = re.compile(rf"{_KEY}{_SETS}[\"'`]?$")
_CODE = re.compile(r"[(\[{<>)\]}]|\$[A-Za-z]|%[A-Za-z]")
_BLANK = re.compile(r"(?i)your|example|change|placeholder|xxx|\*\*\*|redacted|dummy|sample|<.*>|\$\{|\{\{")
#: Types, constants and states that stand where a value would.
BLANKS = frozenset("string integer number boolean object undefined required optional expired invalid missing unknown default hidden disabled enabled password passwd secret username correct incorrect".split())
_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,30}://[^\s:/@\"'<>]{0,64}:([^\s/@\"'<>]{3,128})@(?=[A-Za-z0-9\[])")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----((?:(?!-----)[^\0]){16,}?)-----END ")
_POINTED = re.compile(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+")
_INNER = re.compile(rf"{_KEY}{_SETS}[\"'`]?")
_RUN = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_WORD = re.compile(r"[a-z]{2,}")
GOOD_WORDS = frozenset("token secret password passwd pwd apikey key auth bearer credential credentials private access api login pass".split())
BAD_WORDS = frozenset("commit sha sha1 sha256 md5 hash checksum digest uuid guid id revision version build etag blob tree image layer example sample test dummy serial order isbn phone card account invoice".split())
SCHEMES = "postgres postgresql mysql mongodb mongodb+srv redis amqp http https ftp ssh".split()
DICTIONARY = frozenset(
    "the and for with from this that name user data file path type value item list test config service server client request response handler manager "
    "factory builder module index node error message event state content source target object class method function system process thread default "
    "public private static final import export package version update create delete select insert account number order product customer address "
    "string example placeholder your here change replace sample image page view model controller template layout format parser reader writer "
    "buffer stream socket session cache queue worker task job time date day month year long short high low new old get set put post all one two".split()
)
NAMES = "length runs per_char digits lowers uppers others hex entropy covered distinct slashes path_before address assigned quoted good_word bad_word aligned prefix keyed said code blank symbols spaces login block".split()


def features(text: str, start: int, end: int) -> list[float]:
    """Numbers that describe the candidate text[start:end] and its surroundings."""
    s = text[start:end]
    n = len(s)
    runs = len(_RUN.findall(s))
    digits = sum(c.isdigit() for c in s)
    lowers = sum("a" <= c <= "z" for c in s)
    uppers = sum("A" <= c <= "Z" for c in s)
    counts = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)[1] / n
    low, covered = s.lower(), 0
    for w in _WORD.findall(low):
        i = 0
        while i < len(w):
            k = next((k for k in range(min(12, len(w) - i), 2, -1) if w[i : i + k] in DICTIONARY), 0)
            covered += k
            i += k or 1
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    near = re.findall(r"[a-z0-9]+", (before[-32:] + " ").lower())[-3:]
    keyed = _BEFORE.search(before)
    tight = before.rstrip(" \t\"'`")[-1:]
    return [
        n,
        runs,
        runs / n,
        digits / n,
        lowers / n,
        uppers / n,
        (n - digits - lowers - uppers) / n,
        float(_HEX.fullmatch(s) is not None),
        float(-(counts * np.log2(counts)).sum()),
        covered / n,
        len(counts) / n,
        s.count("/") / n,
        float(before[-1:] in "/\\.~" and before != ""),
        float("://" in before or "://" in s or after[:1] == "."),
        float(tight in ("=", ":", ">")),
        float(before[-1:] in "\"'`" and after[:1] == before[-1:] and before != ""),
        float(any(w in GOOD_WORDS or any(w.endswith(g) for g in ("key", "token", "secret", "password")) for w in near)),
        float(any(w in BAD_WORDS for w in near)),
        float(n in (20, 32, 40, 64)),
        float(re.match(r"AKIA|gh[pousr]_|sk[-_]|xox[abp]-|AIza|eyJ|glpat-", s) is not None),
        float(keyed is not None),
        float(keyed is not None and re.search(r"(?i)\sis:?\s+[\"'`]?$", keyed[0]) is not None),
        len(_CODE.findall(s)),
        float(low in BLANKS or _BLANK.search(s) is not None),
        sum(not c.isalnum() and c not in "+/_-= " for c in s),
        s.count(" "),
        float(after[:1] == "@" and re.search(r"://[^\s:/@]{0,46}:$", before) is not None),
        float(before.endswith("PRIVATE KEY-----")),
    ]


def _signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs of two or three parts between points, the first from its ``eyJ`` on; each part is looked at once."""
    for m in _POINTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        starts = [at := at + len(p) + 1 for p in ["", *parts[:-1]]]
        starts = [x - 1 for x in starts]
        end = -1
        for i, (p, start) in enumerate(zip(parts[:-1], starts)):
            head = p.find("eyJ")
            if start < end or head < 0 or len(p) - head < 11 or len(parts[i + 1]) < 8:
                continue
            last = i + 2 if i + 2 < len(parts) and len(parts[i + 2]) >= 8 else i + 1
            end = starts[last] + len(parts[last])
            yield start + head, end


def _unspaced(text: str, start: int, end: int) -> tuple[int, int] | None:
    """An unspaced value without what closes its surroundings; None if little is left."""
    opened = {close for open_, close in ("()", "[]", "{}", "<>") if open_ in text[start:end]}
    while end > start and (text[end - 1] in ",;." or (text[end - 1] in ")]}>" and text[end - 1] not in opened)):
        end -= 1
    return (start, end) if end - start >= KEYED_LEAST else None


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans to be judged; every character lies in a bounded number of them, so time is linear in the text."""
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        # A run of words, dashes or lines alone is no candidate.
        if any(c.isdigit() for c in s) or re.search(r"[a-z][A-Z]|[A-Z][a-z][A-Z]", s):
            yield m.span()
    for p in (_LOGIN, _BLOCK):
        yield from (m.span(p.groups) for m in p.finditer(text))
    yield from _signed_tokens(text)
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(2 if m[2] is not None else 3)
        if m[2] is None:
            if found := _unspaced(text, start, end):
                yield found
        elif end - start >= KEYED_LEAST:
            yield start, end
        # A value may hold keys of its own; each one's value ends before the next key.
        keys = list(_INNER.finditer(text, start, end))
        for key, after in zip(keys, [*(k.start() for k in keys[1:]), end]):
            stop = min((i for c in "&;,\"'`" if (i := text.find(c, key.end(), after)) >= 0), default=after)
            if found := _unspaced(text, key.end(), stop):
                yield found


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): seeded findings, half of them true secrets."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in r.integers(len(alphabet), size=n))
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = sorted(DICTIONARY)
    fill = lambda: " ".join(chars("etaoinshrdlu", int(r.integers(2, 9))) for _ in range(int(r.integers(1, 6))))
    good, bad = sorted(GOOD_WORDS), sorted(BAD_WORDS)
    out = []
    for i in range(count):
        true = i % 2 == 0
        if true:
            kind = int(r.integers(14))
            s = [
                lambda: chars(hexes, pick([32, 40, 40, 64])),
                lambda: chars(hexes, pick([32, 40])).upper(),
                lambda: chars(b62, int(r.integers(20, 65))),
                lambda: chars(b62 + "+/", int(r.integers(5, 12)) * 4) + pick(["", "=", "=="]),
                lambda: pick(["AKIA", "ghp_", "sk-", "xoxb-", "AIza", "glpat-"]) + chars(b62, int(r.integers(16, 40))),
                lambda: chars(b62 + "_-", int(r.integers(24, 50))),
                lambda: "".join(pick([pick(words), chars("etaoinshrdlu", int(r.integers(4, 8)))]) for _ in range(int(r.integers(4, 7)))),
                lambda: pick(["", chars("etaoinshrdlucmfwyp", 3).title()]) + chars("etaoinshrdlucmfwyp", int(r.integers(5, 9))) + chars("0123456789", int(r.integers(1, 5))) + chars("xyzabc", int(r.integers(4))),
                lambda: chars(b62, int(r.integers(8, 16))),
                lambda: chars(b62 + "!@#%^&*.?~", int(r.integers(7, 20))) + pick("!@#%^&*?~") + chars(b62, 3),
                lambda: chars(b62 + "!%^&*.-", int(r.integers(5, 24))),
                lambda: "\n" + "\n".join(chars(b62 + "+/", 64) for _ in range(int(r.integers(1, 20)))) + "\n",
                lambda: ".".join(["eyJ" + chars(b62, int(r.integers(12, 60))), *(chars(b62 + "_-", int(r.integers(12, 80))) for _ in range(int(r.integers(1, 3))))]),
                lambda: "".join(pick([pick(words), chars("etaoinshrdlu", int(r.integers(4, 8)))]) for _ in range(2)),
            ][kind]()
            key = pick(good) if kind != 4 or r.random() < 0.5 else fill().split()[0]
            if r.random() < 0.4:
                key = pick(words) + pick(["_", "-", " ", ""]) + key
            if r.random() < 0.25:
                key = key.upper()
            text, tail = f"{fill()} {key}" + pick([' = "', "=", ": ", ' := "', '": "', " = '", ' => "', " ", " is ", "='"]), ""
            if kind > 5:
                key = pick(["", "", "db_", "user ", "DB_"]) + pick("password passwd pwd secret token api_key auth_token Password PASSWORD SECRET".split())
                text = f"{fill()} {key}" + pick([' = "', "=", ": ", ' := "', '": "', " = '", "='", ": ", " = "] + [" is "] * (kind != 6))
            tail = (text[-1] if text[-1] in "\"'" else "") + pick(["", " ", "!! ", "### ", ";", ","] if kind < 6 else ["", " ", "; ", ", "]) + fill()
            if kind == 13:
                text = f"{fill()} {pick(['', 'db_', 'DB_', 'user_', 'export '])}{pick('password passwd pwd secret token PASSWORD TOKEN SECRET'.split())}{pick(['=', '=' + chr(34), '=' + chr(39)])}"
            if kind > 5 and text[-1] not in "\"'":
                tail = pick(["", " ", ", "]) and pick([" ", ", ", "; "]) + fill()
            if kind == 10:
                text, tail = f"{fill()} {pick(SCHEMES)}://{chars('etaoinshrdlu', int(r.integers(0, 9)))}:", f"@{chars('etaoinshrdlu', 6)}.{pick(words)}.net{pick([':5432', '', '/'])}{fill()}"
            elif kind == 11:
                text, tail = f"{fill()}\n-----BEGIN {pick(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----", f"-----END {fill()}"
            elif kind == 12:
                text, tail = f"{fill()}{pick([' ', ' Bearer ', ': ', '=', ' token '])}", pick([" ", ", "]) + fill()
        else:
            kind = int(r.integers(14))
            s = [
                lambda: chars(hexes, pick([32, 40, 40, 64])),
                lambda: "-".join(chars(hexes, n) for n in (8, 4, 4, 4, 12)),
                lambda: chars("0123456789", int(r.integers(16, 24))),
                lambda: "_".join(pick(words) for _ in range(int(r.integers(3, 6)))) + pick(["", "_2", "_v1", "3"]),
                lambda: "".join(pick(words).title() for _ in range(int(r.integers(3, 6)))) + pick(["", "2", "V3"]),
                lambda: "/".join(pick(words) for _ in range(int(r.integers(4, 8)))) + str(int(r.integers(10))),
                lambda: pick(["your", "my", "example", "changeme", "xxxx"]) + pick(["_", "-"]) + pick(good) + pick(["_here_", "-"]) + pick(["123456", "xxxxxxxx1", "0000000000"]),
                lambda: pick("x0a1A") * int(r.integers(16, 40)) + pick(["", "1"]),
                lambda: chars("etaoinshrdlu", int(r.integers(16, 30))) + str(int(r.integers(10))),
                lambda: pick(sorted(BLANKS)),
                lambda: pick([f"{pick(words)}.{pick(words)}({pick(words)})", f"get_{pick(words)}()", "${" + pick(words).upper() + "_KEY}", f"<{pick(words)}-{pick(words)}>", "{{ " + pick(words) + ".value }}", f'os.environ[{pick(words)}]', f"{pick(words)}[{pick(words)}]", f"{pick(words)}({pick(words)}, {pick(words)})"]),
                lambda: pick(["your_password", "your-token", "changeme", "xxxxxxxx", "********", "example-token", "<password>", "YOUR_SECRET", "placeholder", "redacted", "my_example_key"]),
                lambda: chars("etaoinshrdlucm", int(r.integers(6, 12))),
                lambda: pick(["password", "PASSWORD", "${" + pick(words).upper() + "}", "$" + pick(words).upper(), "%s", "{" + pick(words) + "}", "xxxx", "****", "your-password", "secret"]),
            ][kind]()
            if kind in (0, 1):
                text = f"{fill()} {pick(bad)}" + pick([" ", ": ", "=", ' = "', ":", " is "])
            elif kind == 6:
                text = f"{fill()} {pick(good)}" + pick([' = "', "=", ": "])
            elif kind == 5:
                text = f"{fill()} " + pick(["/", "./", "~/", "http://", "src/"])
            else:
                text = f"{fill()} " + pick(["", f"{pick(words)} = ", f"{pick(bad)} ", "(", "no ", f"{pick(words)}: "])
            if kind > 8:
                key = pick(["", "", "db_", "user ", "the "]) + pick("password passwd pwd secret token api_key auth_token Password key login".split())
                text = f"{fill()} {key}" + pick([": ", " is ", " = "] if kind == 12 else [": ", " = ", "=", " is "] + [' = "', ': "'] * (kind in (9, 11)))
            if kind == 13:
                text = f"{fill()} {pick(SCHEMES)}://{pick(['user', 'username', '${USER}', chars('etaoinshrdlu', 4)])}:"
            tail = f"@{pick(['host', 'localhost', chars('etaoinshrdlu', 6)])}/{fill()}" if kind == 13 else ('"' if text.endswith('"') else "") + (pick(["", " ", ".py", "(", "!! ", ","]) if kind < 9 else pick([" ", ", ", "; "])) + fill()
        out.append((text + s + tail, len(text), len(text) + len(s), int(true)))
    return out


class Forest:
    """Trees as arrays: feature, cut, children (or -1) and the share of secrets in a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = r.integers(len(y), size=len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, r, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator, nodes: list[list[float]]) -> int:
        me = len(nodes)
        nodes.append([-1, 0, -1, -1, float(y.mean())])
        if depth and len(y) >= 2 * LEAF_ROWS and 0 < y.mean() < 1:
            best = None
            for f in r.choice(x.shape[1], size=max(1, int(np.sqrt(x.shape[1]))), replace=False):
                for cut in np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9))):
                    left = x[:, f] <= cut
                    n = int(left.sum())
                    if LEAF_ROWS <= n <= len(y) - LEAF_ROWS:
                        p, q = y[left].mean(), y[~left].mean()
                        impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                        if best is None or impurity < best[0]:
                            best = impurity, int(f), float(cut), left
            if best:
                _, f, cut, left = best
                a = self._grow(x[left], y[left], depth - 1, r, nodes)
                b = self._grow(x[~left], y[~left], depth - 1, r, nodes)
                nodes[me][:4] = [f, cut, a, b]
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := t[at, 0] >= 0).any():
                f = t[at, 0].astype(np.int64)
                right = x[np.arange(len(x)), np.maximum(f, 0)] > t[at, 1]
                at = np.where(inner, np.where(right, t[at, 3], t[at, 2]).astype(np.int64), at)
            total += t[at, 4]
        return total / len(self.trees)


def fit(findings: list[tuple[str, int, int, int]]) -> Forest:
    """A forest from labelled findings (text, start, end, label)."""
    x = np.array([features(t, a, b) for t, a, b, _ in findings])
    return Forest(x, np.array([v for *_, v in findings], dtype=float))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return fit(labelled_findings())


def findings(text: str, forest: Forest) -> list[tuple[int, int, float]]:
    """(start, end, score) of the secrets in a text."""
    spans = list(candidates(text))
    out = []
    # In steps, so that a text full of candidates needs no large table.
    for i in range(0, len(spans), 1_000):
        step = spans[i : i + 1_000]
        scores = forest.score(np.array([features(text, a, b) for a, b in step]))
        out += [(a, b, float(s)) for (a, b), s in zip(step, scores) if s >= THRESHOLD]
    kept: list[tuple[int, int, float]] = []
    for a, b, s in sorted(set(out), key=lambda x: (x[0], -x[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, s))
        elif b > kept[-1][1]:
            # Both are secrets: the finding covers them.
            kept[-1] = kept[-1][0], b, max(s, kept[-1][2])
    return kept


def masked(text: str, found: list[tuple[int, int, float]]) -> str:
    at, parts = 0, []
    for a, b, _ in found:
        parts += [text[at:a], MASK]
        at = b
    return "".join([*parts, text[at:]])


FOUND = "doc_id long, start long, length long, score double"
#: Cheap test on the bytes; a text without it has no candidate.
_MAYBE = re.compile(rb"[A-Za-z0-9+/_\-]{16}|://[^\s:/@]{0,64}:[^\s/@]{3,128}@|(?i:pass|pwd|secret|token|credential|key|auth|login|bearer)")


def _scan(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids = [], batch.column("doc_id").to_pylist()
            for name, text in zip(ids, texts_of(batch.column("text")).cast(pa.large_binary())):
                raw = text.as_py()
                if _MAYBE.search(raw):
                    out += [(name, a, b - a, s) for a, b, s in findings(raw.decode(errors="replace"), forest)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _mask(forest: Forest, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(column).to_pylist():
                found = findings(text, forest) if text and _MAYBE.search(text.encode()) else []
                texts.append(masked(text, found) if found else text)
            at = batch.schema.get_field_index(column)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def scan_secrets(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """One row for each secret in ``docs`` (doc_id, text): start and length in code points, and the forest's score."""
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return rows.mapInArrow(_scan(forest or default_forest()), FOUND)


def mask_secrets(docs: DataFrame, forest: Forest | None = None, column: str = "text") -> DataFrame:
    """``docs`` with every secret in ``column`` replaced by MASK; all columns stay."""
    return docs.mapInArrow(_mask(forest or default_forest(), column), docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))
