"""Secret scans with a linear-chain conditional random field.

Fixed patterns give the base spans.  A conditional random field (CRF) tags
tokens as the beginning of a secret, inside one, or outside (B, I, O), from
their shape, their neighbouring words and features of the file; Viterbi finds
the best tags of each line.  Every token of every line takes part: runs of
bytes other than white space and quoting marks, and each such mark by itself.

The scores of all tokens of a batch are sums of table entries, taken for all
tokens at once; a token's shape is looked at once for each distinct token.  A
bound on what any path through a token other than O can gain tells which tokens
are O on the best path of their line; Viterbi runs over the others, between
tokens that are surely O, so that the result is that of decoding whole lines.

The CRF is trained here by gradient ascent on the conditional likelihood, on
lines of a bounded sample of documents tagged by the base patterns and on
generated lines of common secret forms (``generated``, ``generated_near``).
Half of the lines with a base span are also shown with their key words hidden,
so that shapes and not only names teach.

Cases: null text counts as empty; base spans of different kinds may overlap;
CRF spans that touch a base span are not repeated; of paths with equal scores
the one with the smaller tags is taken; repeated rows are independent and get
equal spans; a very long text is a part of its own, and is held as a whole with its tokens;
only the id and the text are read, so further columns of any name do no harm; a
table without documents leaves the generated lines to train on, and gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts, released

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that must occur, in lower case, before the assignment pattern is tried.
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

#: Tokens that name a secret.
_WORDY = "(?i)pass|pwd|secret|token|key|auth|cred|bearer|sign"
_MARKS = b"\"'`<>()[]{},;:=|"
TAGS = 3  # O, B, I
#: Bounds of the training sample: documents, their lines without a secret, and tokens of a line.
TRAINING_DOCUMENTS = 6_000
TRAINING_LINES = 1_000
TRAINING_TOKENS = 400
ROUNDS = 60
#: Texts are scanned together up to so many characters.
PART_CHARS = 2_000_000

_SPACE, _MARK, _BODY, _LINE = range(4)
_BYTE = np.full(256, _BODY, np.uint8)
_BYTE[:33] = _SPACE
_BYTE[list(_MARKS)] = _MARK
_BYTE[10] = _LINE
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_HEXES = _DIGIT.copy()
_HEXES[97:103] = True

#: Classes of neighbours, and how many values each feature of a token has.
NONE, WORD, KEY, DIGITS, OTHER = range(5)
CLASSES = 5 + len(_MARKS)
SHAPES = (16, 12, 6, 6, 6, 5, 5, 2, 4, 3, CLASSES)  # letters, length, digits, entropy, changes, cases, inner marks, hex, dots, path, class
AROUND = (CLASSES, CLASSES, CLASSES, CLASSES, 2, 2, 2, 5)  # before 1, 2, 3, behind, a key among them, no gap before, key in the file, density
SIZES = (*SHAPES, *AROUND)
FIRST = np.concatenate(([0], np.cumsum(SIZES)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and then by kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))




@dataclass
class Tokens:
    """Tokens of some texts, joined by line ends: bytes of start and end, line, text, distinct token, and gap before."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    text: np.ndarray
    code: np.ndarray
    distinct: pa.Array
    #: First byte of each text, and one more.
    texts: np.ndarray


def tokens(texts: Sequence[str]) -> Tokens:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts)
    first = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    data = np.frombuffer(raw, np.uint8)
    kind = _BYTE[data]
    body = kind == _BODY
    edge = np.diff(np.concatenate(([0], body.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    marks = np.flatnonzero(kind == _MARK)
    start, end = np.concatenate((starts, marks)), np.concatenate((ends, marks + 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    held = body | (kind == _MARK)
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[held].tobytes())])
    coded = words.dictionary_encode()
    lines = np.concatenate(([0], np.cumsum(kind == _LINE)))
    return Tokens(raw, start, end, lines[start], np.searchsorted(first, start, "right") - 1, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first)


def shapes(distinct: pa.Array) -> np.ndarray:
    """Values of the ``SHAPES`` of each distinct token."""
    n = len(distinct)
    if not n:
        return np.zeros((0, len(SHAPES)), np.int64)
    offsets = np.frombuffer(distinct.buffers()[1], np.int64, n + 1, distinct.offset * 8)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begin = offsets[:-1] - offsets[0]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), begin)

    upper, lower, digit = count(_UPPER[data]), count(_LOWER[data]), count(_DIGIT[data])
    inner = owner[1:] == owner[:-1]
    is_digit = _DIGIT[data]
    changes = np.bincount(owner[1:][inner & (is_digit[1:] != is_digit[:-1])], minlength=n)
    cases = np.bincount(owner[1:][inner & _LOWER[data[:-1]] & _UPPER[data[1:]]], minlength=n)
    same, times = np.unique(owner << 8 | data, return_counts=True)
    share = times / size[same >> 8]
    entropy = np.bincount(same >> 8, -share * np.log2(share), n)
    odd = size - upper - lower - digit
    plain = count(np.isin(data, np.frombuffer(b".-_/:", np.uint8)))
    dots = count(data == 46)
    key = pc.match_substring_regex(distinct, _WORDY).to_numpy(zero_copy_only=False)
    kind = np.where(key, KEY, np.where(digit == size, DIGITS, np.where(upper + lower + digit > 0, WORD, OTHER)))
    single = (size == 1) & (_BYTE[data[begin]] == _MARK)
    mark = np.zeros(256, np.int64)
    mark[list(_MARKS)] = 5 + np.arange(len(_MARKS))
    kind = np.where(single, mark[data[begin]], kind)
    out = (
        (upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (odd > 0),
        np.where(size < 8, size - 1, np.minimum(7 + size // 8, 11)),
        np.minimum(digit * 5 // size, 5), np.minimum(entropy.astype(np.int64), 5), np.minimum(changes, 5), np.minimum(cases, 4), np.minimum(odd - plain, 4),
        count(_HEXES[data]) == size, np.minimum(dots, 3), np.minimum(count(data == 47), 2), kind,
    )
    return np.stack([np.asarray(x, np.int64) for x in out], axis=1)


def around(t: Tokens, kind: np.ndarray) -> np.ndarray:
    """Values of ``AROUND`` of each token; ``kind`` are the classes of the tokens."""
    n = len(t.start)
    out = np.zeros((n, len(AROUND)), np.int64)
    for column, step in enumerate((1, 2, 3)):
        same = np.zeros(n, bool)
        same[step:] = t.line[step:] == t.line[:-step]
        out[same, column] = kind[np.flatnonzero(same) - step]
    same = np.zeros(n, bool)
    same[:-1] = t.line[1:] == t.line[:-1]
    out[same, 3] = kind[np.flatnonzero(same) + 1]
    out[:, 4] = (out[:, :3] == KEY).any(axis=1)
    out[1:, 5] = t.start[1:] == t.end[:-1]
    keys = np.bincount(t.text[kind == KEY], minlength=len(t.texts) - 1)
    held = np.diff(t.texts)
    out[:, 6] = keys[t.text] > 0
    out[:, 7] = np.minimum(keys * 2_000 // (held + 1), 4)[t.text]
    return out


@dataclass
class Crf:
    """Weights of a linear chain: feature values x tags, and tag x tag transitions (from O and back to O at the ends)."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, t: Tokens) -> np.ndarray:
        """Emission scores of all tokens."""
        own = shapes(t.distinct)
        table = np.zeros((len(own), TAGS))
        for k in range(len(SHAPES)):
            table += self.weights[FIRST[k] + own[:, k]]
        out = table[t.code]
        near = around(t, own[t.code, -1]) if len(own) else np.zeros((0, len(AROUND)), np.int64)
        for k in range(len(AROUND)):
            out += self.weights[FIRST[len(SHAPES) + k] + near[:, k]]
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of a run between tokens that are O."""
        best = scores[0] + self.moves[0]
        back = []
        for row in scores[1:]:
            paths = best[:, None] + self.moves
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        tags = [int((best + self.moves[:, 0]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def open(self, scores: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Which tokens may be other than O on the best path of their line.

        A stretch of other tags gains, against O, at most the sum over its tokens
        of their best tag's lead and the best move's lead, and one move more.
        """
        if not len(scores):
            return np.zeros(0, bool)
        step = max(float((self.moves - self.moves[0, 0]).max()), 0.0)
        lead = scores[:, 1:].max(axis=1) - scores[:, 0] + step
        new = np.append(True, line[1:] != line[:-1])
        lost = float(np.abs(lead).max() * 2 + step + 1)

        def best_end(lead: np.ndarray, new: np.ndarray) -> np.ndarray:
            """The greatest sum of a stretch that ends at each token, in its line."""
            # A line begins with a loss that no stretch makes up for.
            at = np.flatnonzero(new)
            sizes = np.diff(np.append(at, len(lead)))
            total = np.cumsum(np.insert(lead, at, -lost * (np.concatenate(([1], sizes[:-1])) + 1)))
            low = np.minimum.accumulate(total)
            places = np.arange(len(lead)) + np.cumsum(new)
            return total[places] - low[places - 1]

        front = best_end(lead, new)
        back = best_end(lead[::-1], np.append(True, (line[1:] != line[:-1])[::-1]))[::-1]
        return front + back - lead + step > -1e-6

    def decode(self, t: Tokens) -> list[tuple[int, int]]:
        """(first token, last token) of the secrets of all texts."""
        scores = self.scores(t)
        at = np.flatnonzero(self.open(scores, t.line))
        if not len(at):
            return []
        cut = np.flatnonzero((np.diff(at) > 1) | (t.line[at[1:]] != t.line[at[:-1]])) + 1
        out = []
        for run in np.split(at, cut):
            begin = None
            for k, tag in zip(run.tolist(), self.viterbi(scores[run]), strict=True):
                if tag == 1 or tag == 2 and begin is None:
                    if begin is not None:
                        out.append((begin, last))
                    begin = k
                if tag == 0 and begin is not None:
                    out.append((begin, last))
                    begin = None
                last = k
            if begin is not None:
                out.append((begin, last))
        return out


def fit(features: np.ndarray, tags: np.ndarray, line: np.ndarray, rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> Crf:
    """Maximum conditional likelihood by AdaGrad, with forward-backward over all lines at once.

    ``features`` holds, for each token, a value number for each feature; ``line`` rises.
    """
    w, t = np.zeros((FIRST[-1], TAGS)), np.zeros((TAGS, TAGS))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    barred = np.zeros((TAGS, TAGS))
    barred[0, 2] = -50.0  # O to I
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    size = np.diff(np.append(first, len(line)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size.max(initial=0))
    # Lines still running at each place, the longest first.
    alive = [int(np.searchsorted(-size, -k, "left")) for k in range(longest)]
    gold = np.zeros((len(features), TAGS))
    gold[np.arange(len(tags)), tags] = 1
    before = np.where(np.append(True, line[1:] != line[:-1]), 0, np.append(0, tags[:-1]))
    gold_moves = np.zeros_like(t)
    np.add.at(gold_moves, (before, tags), 1)
    np.add.at(gold_moves, (tags[np.append(line[1:] != line[:-1], True)], 0), 1)
    n = len(features)
    for _ in range(rounds):
        e = sum(w[features[:, k]] for k in range(features.shape[1]))
        m = t + barred
        f, b = np.zeros((n, TAGS)), np.zeros((n, TAGS))
        for k in range(longest):
            at = first[: alive[k]] + k
            f[at] = e[at] + (m[0] if k == 0 else np.logaddexp.reduce(f[at - 1][:, :, None] + m, axis=1))
        last = first + size - 1
        b[last] = m[:, 0]
        for k in range(longest - 2, -1, -1):
            at = first[: alive[k + 1]] + k
            b[at] = np.logaddexp.reduce(m + (e[at + 1] + b[at + 1])[:, None, :], axis=2)
        z = np.zeros(n)
        z[last] = np.logaddexp.reduce(f[last] + b[last], axis=1)
        z = z[np.repeat(np.flatnonzero(np.append(line[1:] != line[:-1], True)), np.diff(np.flatnonzero(np.append(np.append(True, line[1:] != line[:-1]), True))))]
        state = np.exp(f + b - z[:, None])
        inner = np.flatnonzero(np.append(False, line[1:] == line[:-1]))
        seen = np.exp(f[inner - 1][:, :, None] + m + (e[inner] + b[inner])[:, None, :] - z[inner][:, None, None]).sum(axis=0)
        seen[0] += state[first].sum(axis=0)
        seen[:, 0] += state[last].sum(axis=0)
        error = gold - state
        step = np.zeros_like(w)
        for k in range(features.shape[1]):
            for tag in range(TAGS):
                step[:, tag] += np.bincount(features[:, k], error[:, tag], len(w))
        step -= decay * n * w / 100
        gw += step**2
        w += rate * step / np.sqrt(gw)
        grad = gold_moves - seen
        gt += grad**2
        t += rate * grad / np.sqrt(gt)
    return Crf(w, t + barred)


def generated(seed: int = 11, lines: int = 900) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines of common forms with the spans of their secrets; most hold none."""
    pick = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def some(alphabet: str, n: int) -> str:
        return "".join(pick.choice(alphabet) for _ in range(n))

    words = [some("abcdefghijklmnopqrstuvwxyz", pick.randrange(2, 10)) for _ in range(200)]
    out = []
    for _ in range(lines):
        lead = " ".join(pick.choices(words, k=pick.randrange(0, 6)))
        tail = " ".join(pick.choices(words, k=pick.randrange(0, 6)))
        name = pick.choice(("password", "client_secret", "auth_token", "api-key", "private key", "Authorization: Bearer", "pwd", "signing_key"))
        sign = pick.choice((" = ", ": ", "=", ':"', " "))
        secret = pick.choice((some(letters, pick.randrange(16, 48)), some("0123456789abcdef", 32), "sk-" + some(letters, 32), "ghp_" + some(letters, 36), some(letters + "+/", 40) + "=="))
        plain = pick.choice(
            (
                some("0123456789", pick.randrange(8, 20)),
                f"20{pick.randrange(10, 30)}-{pick.randrange(10, 13)}-{pick.randrange(10, 29)}",
                f"http://{pick.choice(words)}.example.com/{pick.choice(words)}{pick.randrange(99)}",
                f"{pick.choice(words)}.{pick.randrange(99)}@mail.example.com",
                f"{pick.randrange(256)}.{pick.randrange(256)}.{pick.randrange(256)}.{pick.randrange(256)}",
                f"{pick.choice(words)}_{pick.choice(words)}_{pick.randrange(9)}",
                f"v{pick.randrange(9)}.{pick.randrange(99)}.{pick.randrange(99)}",
                pick.choice(words) * 5,
            )
        )
        if pick.random() < 0.35 or "key" in lead:
            head = f"{lead} {name}{sign}"
            out.append((f"{head}{secret} {tail}", [(len(head), len(head) + len(secret))]))
        else:
            out.append((f"{lead} {plain} {tail}", []))
    return out


def generated_near(seed: int = 12, lines: int = 1_200) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with a key word: half with a short, wordy or punctuated secret, half with plain words."""
    pick = random.Random(seed)
    lower = "abcdefghijklmnopqrstuvwxyz"
    letters, digits, marks = lower + lower.upper(), "0123456789", "!@#$%^&*?+_-"

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(pick.choices(alphabet, k=pick.randrange(low, high)))

    def mixed(*parts: str) -> str:
        out = [c for part in parts for c in part]
        pick.shuffle(out)
        return "".join(out)

    words = [some(lower, 1, 11) for _ in range(400)]
    names = ("password", "passwd", "pwd", "pass", "passphrase", "auth", "Authorization", "bearer", "client key", "key", "secret", "token", "credential", "sign key")
    out = []
    for k in range(lines):
        lead, tail = (" ".join(pick.choices(words, k=pick.randrange(0, 6))) for _ in range(2))
        head = f"{lead} {pick.choice(names)}{pick.choice((': ', ' = ', '=', ' ', ' is ', ':'))}"
        secret = pick.choice(
            (
                mixed(some(letters, 4, 9), some(digits, 1, 4)),
                "".join(some(lower, 3, 9).capitalize() for _ in range(pick.randrange(2, 5))),
                mixed(some(lower, 5, 12), some(lower.upper(), 5, 12)),
                mixed(some(letters, 4, 12), some(digits, 1, 5), some(marks, 1, 5)),
            )
        )
        plain = pick.choice((*pick.sample(words, 4), pick.choice(words).capitalize(), some(digits, 1, 9), f"20{pick.randrange(10, 30)}-0{pick.randrange(1, 10)}-{pick.randrange(10, 29)}", f"{pick.choice(words)}.", f"{pick.choice(words)},"))
        quote = pick.choice(("", "", '"', "'"))
        if k % 2:
            out.append((f"{head}{quote}{plain}{quote} {tail}", []))
        else:
            head += quote
            out.append((f"{head}{secret}{quote} {tail}", [(len(head), len(head) + len(secret))]))
    return out


def training_rows(texts: Sequence[str], secrets: Sequence[list[tuple[int, int]]], hide: Sequence[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, tags, line, text) of the tokens of texts with their secrets (in code points); key words count as words where ``hide`` says so."""
    t = tokens(texts)
    own = shapes(t.distinct)
    kind = own[t.code, -1] if len(own) else np.zeros(0, np.int64)
    hidden = np.asarray(hide, bool)[t.text] if len(t.text) else np.zeros(0, bool)
    kind = np.where(hidden & (kind == KEY), WORD, kind)
    values = np.concatenate((own[t.code], around(t, kind)), axis=1)
    values[:, len(SHAPES) - 1] = kind
    tags = np.zeros(len(t.start), np.int64)
    for k, spans in enumerate(secrets):
        for a, b in spans:
            low, high = (t.texts[k] + len(texts[k][:x].encode("utf-8", "surrogatepass")) for x in (a, b))
            inside = np.flatnonzero((t.start < high) & (t.end > low))
            tags[inside] = 2
            tags[inside[:1]] = 1
    return values + FIRST[:-1], tags, t.line, t.text


def _value(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The secret itself in a base span: of an assignment the value."""
    if kind == "assign" and (m := _ASSIGN.match(text, a, b)):
        return m.span(2)
    return a, b


def train(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Crf:
    """CRF from lines of at most ``TRAINING_DOCUMENTS`` documents (smallest hashes of the ids) and the generated lines.

    Base spans are the labels; numbers that only look like hex are outside.
    The driver gets at most ``TRAINING_LINES`` lines with and as many without a
    secret, the smallest hashes of each; a longer line is several of ``TRAINING_TOKENS`` words.
    """
    ids = documents.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(F.lit("secrets"), key), key).limit(TRAINING_DOCUMENTS)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                for line in (value.as_py() or "").split("\n"):
                    words = line.split(" ")
                    for at in range(0, len(words), TRAINING_TOKENS):
                        piece = " ".join(words[at : at + TRAINING_TOKENS])
                        found = sorted({_value(k, piece, a, b) for k, a, b in base_spans(piece) if not piece[a:b].isdigit()})
                        rows.append((piece, bool(found), ",".join(f"{a}:{b}" for a, b in found)))
            rows = list(dict.fromkeys(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string())], ["line", "held", "spans"])

    chosen = documents.join(F.broadcast(ids), key, "left_semi").select(text)  # TRAINING_DOCUMENTS ids at most
    seen = materialize(chosen.mapInArrow(released(extract), "line string, held boolean, spans string").where("line != ''"), "secrets-lines")
    by_hash = F.xxhash64(F.lit("secrets"), "line")
    lines, secrets, hide = [], [], []
    for held in (True, False):
        for r in seen.where(F.col("held") == F.lit(held)).distinct().orderBy(by_hash, "line").limit(TRAINING_LINES).collect():
            spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
            for hidden in (False, True) if held and len(lines) % 2 == 0 else (False,):
                lines.append(r.line)
                secrets.append(spans)
                hide.append(hidden)
    for line, spans in generated() + generated_near():
        lines.append(line)
        secrets.append(spans)
        hide.append(False)
    features, tags, line, _ = training_rows(lines, secrets, hide)
    return fit(features, tags, line)


Span = tuple[str, int, int]


def scan_texts(texts: Sequence[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, each by start and then by kind; CRF spans are of kind ``crf``."""
    t = tokens(texts)
    extra: list[list[Span]] = [[] for _ in texts]
    for a, b in crf.decode(t):
        k = int(t.text[a])
        first = int(t.texts[k])
        low = len(t.raw[first : t.start[a]].decode("utf-8", "surrogatepass"))
        extra[k].append(("crf", low, low + len(t.raw[t.start[a] : t.end[b]].decode("utf-8", "surrogatepass"))))
    out = []
    order = (*KINDS, "crf")
    for text, more in zip(texts, extra, strict=True):
        base = base_spans(text)
        more = [s for s in more if not any(s[1] < e and b < s[2] for _, b, e in base)]
        out.append((base, sorted(base + more, key=lambda s: (s[1], order.index(s[0]), s[2]))))
    return out


def scan(text: str, crf: Crf) -> tuple[list[Span], list[Span]]:
    return scan_texts([text], crf)[0]


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(df: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_spans) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[list[Span], list[Span]]] = []
            for part in parts(batch.column(1), chars=PART_CHARS):
                found += scan_texts(part, crf)
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
            digests = [hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in found]
            spans = [span_text(every) for _, every in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array([len(e) for _, e in found], pa.int64())],
                [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(released(run), f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")
