"""Secret scans: a linear-chain conditional random field tags tokens as begin, inside or outside of a secret.

A text's tokens are runs of letters and digits, and single other characters. A token's score for each tag is a sum of weights: of
its own shape, of the words, marks and shapes beside it, of the last word nearby that names secrets, and of its file's make-up.
The best tags of a whole text are found by Viterbi. A token that no path could gain from tagging otherwise than outside (by the
weights of the transitions) parts a text, so that only the stretches between such tokens are walked; the result is the same.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of spans in the order in which they are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "secret")
# The base patterns, the words that an assignment has one of, and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words that a neighbour is told apart by: first those that name secrets.
NAMING = "password passwd pwd pass passphrase secret secrets token tokens api apikey key keys auth authorization bearer credential credentials access private client session cookie login signing encryption webhook bot ssh pin passcode pw psk".split()
OTHER = "commit revision sha1 sha256 md5 checksum digest version isbn issn phone tel order invoice ref id uuid item no page chapter http https www com org file img color is was the of a to and user username host port".split()
O, B, I = 0, 1, 2  # noqa: E741
_NEVER = -1e9

_CLASS = np.full(256, 5, np.int8)  # 0 blank, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 any other mark
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def _hash(word: str) -> int:
    return sum((b + 1) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(word.encode())) % (1 << 64)


_WORDS = np.array([_hash(w) for w in NAMING + OTHER], np.uint64)
_SORTED = np.argsort(_WORDS)
N_WORDS = len(_WORDS) + 1
#: Numbers of values of each feature, in the order in which `features` gives them.
SIZES = (10, 16, 64, 6, 128, N_WORDS, N_WORDS, N_WORDS, N_WORDS, 128, 128, 128, 16, 16, 9, 7, 16, 64)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])[:-1].astype(np.int32)


class Tokens:
    """The tokens of some texts: bytes start to end, the text each is of, and its features as row numbers of the weights."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)  # of the texts in data
        kind = _CLASS[data]
        word = (kind > 0) & (kind < 5)
        starts = kind == 5
        starts[0] |= word[0] if len(word) else False
        starts[1:] |= word[1:] & ~word[:-1]
        self.start = np.flatnonzero(starts)
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1 if len(word) else np.zeros(0, np.int64)
        self.end = self.start + 1
        is_word = word[self.start]
        self.end[is_word] = ends
        self.text = np.searchsorted(self.begin, self.start, side="right") - 1
        self.rows = self._features(data, kind, is_word)

    def _features(self, data: np.ndarray, kind: np.ndarray, is_word: np.ndarray) -> np.ndarray:
        s, e, n = self.start, self.end, len(self.start)
        counts = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (1, 2, 3, 4)]
        mix = sum(((c[e] > c[s]).astype(np.int64) << i) for i, c in enumerate(counts))
        length = e - s
        turns = np.concatenate([[0], np.cumsum(np.concatenate([[False], kind[1:] != kind[:-1]]), dtype=np.int32)])
        turned = turns[e] - turns[np.minimum(s + 1, len(turns) - 1)]
        mark = np.where(is_word, 0, np.minimum(data[s], 127)).astype(np.int64)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _STEP, np.uint64)]))
        backs = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _BACK, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        hashed = (sums[e] - sums[s]) * backs[s]
        at = np.minimum(np.searchsorted(_WORDS, hashed, sorter=_SORTED), len(_WORDS) - 1)
        known = np.where(_WORDS[_SORTED[at]] == hashed, _SORTED[at] + 1, 0)
        lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])[s]
        gap = np.zeros(n, np.int64)
        if n:
            gap[1:] = np.where(lines[1:] != lines[:-1], 2, s[1:] > e[:-1])
            gap[0] = 2
        # the last naming word of the same line, so many tokens ago
        i = np.arange(n)
        last = np.maximum.accumulate(np.where((known > 0) & (known <= len(NAMING)), i, -1))
        last = np.concatenate([[-1], last[:-1]]) if n else last
        ago = np.where((last >= 0) & (lines[np.maximum(last, 0)] == lines), i - last, 99)
        per_text = [np.bincount(self.text, weights=w, minlength=len(self.begin)) for w in (np.ones(n), is_word & (mix & 4 > 0), mark == 61, mix & 3 == 3)]
        many = np.maximum(per_text[0], 1)
        file = np.digitize(per_text[1] / many, (0.01, 0.05, 0.2)) * 16 + np.digitize(per_text[2] / many, (0.001, 0.01, 0.05)) * 4 + np.digitize(per_text[3] / many, (0.01, 0.1, 0.3))

        def beside(values: np.ndarray, by: int) -> np.ndarray:
            """Of the token so many places on, 0 where that is of another text."""
            out = np.zeros(n, np.int64)
            if by < 0:
                out[-by:] = np.where(self.text[-by:] == self.text[:by], values[:by], 0)
            else:
                out[:-by] = np.where(self.text[:-by] == self.text[by:], values[by:], 0)
            return out

        long = np.digitize(length, (8, 16, 24))
        columns = (
            np.digitize(length, (2, 3, 4, 6, 9, 16, 20, 28, 40)), mix, mix * 4 + long, np.digitize(turned, (1, 2, 3, 6, 12)), mark, known, beside(known, -1), beside(known, -2), beside(known, -3),
            beside(mark, -1), beside(mark, -2), beside(mark, 1), beside(mix, -1), beside(mix, 1), gap * 3 + np.where(beside(np.ones(n, np.int64), 1) == 0, 2, np.concatenate([gap[1:], [2]]) if n else gap),
            np.digitize(ago, (2, 3, 4, 7, 11, 99)), (ago < 11) * 8 + (long > 0) * 4 + np.digitize(turned, (1, 3, 8)), file[self.text],
        )
        return np.stack([np.asarray(c, np.int32) + o for c, o in zip(columns, OFFSETS, strict=True)], axis=1)


class Field:
    """Weights of the features for each tag, and of the transitions; a text stands between two outside tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves.copy()
        self.moves[O, I] = _NEVER

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for f in range(rows.shape[1]):
            out += self.weights[rows[:, f]]
        return out

    def outside(self, scores: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path: whatever stands beside them, another tag scores less. `last` says where a
        text ends. If inside follows, that becomes begin."""
        m, sure = self.moves, np.ones(len(scores), bool)
        onward = np.where(last, 0, np.concatenate([scores[1:, B] - scores[1:, I], [0.0]]) if len(scores) else 0.0)
        for x in (B, I):
            into = max(m[a, x] - m[a, O] for a in (O, B, I) if (a, x) != (O, I))
            plain = into + max(m[x, y] - m[O, y] for y in (O, B))
            carried = into + m[x, I] - m[O, B] + max(m[I, z] - m[B, z] for z in (O, B, I))
            less = scores[:, O] - scores[:, x]
            sure &= (less > plain) & (last | (less + onward > carried))
        return sure

    def decode(self, scores: np.ndarray, text: np.ndarray, cut: bool = True) -> np.ndarray:
        """The best tags of all tokens; `cut` only spares work."""
        n, tags = len(scores), np.zeros(len(scores), np.int8)
        if not n:
            return tags
        last = np.concatenate([text[1:] != text[:-1], [True]])
        open_ = ~self.outside(scores, last) if cut else np.ones(n, bool)
        follows = np.concatenate([[False], open_[:-1] & ~last[:-1]])
        begins = np.flatnonzero(open_ & ~follows)
        ends = np.flatnonzero(open_ & np.concatenate([last[:-1] | ~open_[1:], [True]])) + 1
        sizes = ends - begins
        for scale in np.unique(np.frexp(sizes)[1]):
            some = np.frexp(sizes)[1] == scale
            self._walk(scores, tags, begins[some], sizes[some])
        return tags

    def _walk(self, scores: np.ndarray, tags: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        best, came = self.moves[O] + scores[begins], np.zeros((int(sizes.max()), len(begins), 3), np.int8)
        for k in range(1, len(came)):
            on = sizes > k
            paths = best[:, :, None] + self.moves
            came[k] = paths.argmax(1)
            best[on] = paths.max(1)[on] + scores[begins[on] + k]
        tag = (best + self.moves[:, O]).argmax(1)
        for k in range(len(came) - 1, -1, -1):
            on = sizes > k
            tags[begins[on] + k] = tag[on]
            tag = np.where(on & (k > 0), came[k][np.arange(len(tag)), tag], tag)


def train(rows: np.ndarray, tags: np.ndarray, rounds: int = 120, rate: float = 0.1, keep: float = 2e-4) -> Field:
    """A field fitted to windows (rows: window x place x feature; tags: window x place) by the likelihood's gradient."""
    windows, places, n_features = rows.shape
    size = int(sum(SIZES))
    theta, moved = [np.zeros((size, 3)), np.zeros((3, 3))], [[np.zeros((size, 3)), np.zeros((3, 3))] for _ in range(2)]
    flat, told = rows.reshape(-1, n_features), np.eye(3)[tags]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (tags[:, :-1], tags[:, 1:]), 1)
    np.add.at(pairs, (O, tags[:, 0]), 1)
    np.add.at(pairs, (tags[:, -1], O), 1)
    add = lambda x, axis: np.log(np.exp(x - (top := x.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    for t in range(1, rounds + 1):
        field = Field(*theta)
        e, m = field.scores(flat).reshape(windows, places, 3), field.moves
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0], behind[:, -1] = m[O] + e[:, 0], m[:, O]
        for k in range(1, places):
            ahead[:, k] = add(ahead[:, k - 1, :, None] + m, 1) + e[:, k]
        for k in range(places - 2, -1, -1):
            behind[:, k] = add(m + (e[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
        all_ = add(ahead[:, -1] + m[:, O], 1)[:, None, None]
        share = np.exp(ahead + behind - all_)
        met = np.exp(ahead[:, :-1, :, None] + m + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - all_[..., None]).sum((0, 1))
        met[O] += share[:, 0].sum(0)
        met[:, O] += share[:, -1].sum(0)
        over = (share - told).reshape(-1, 3)
        slopes = [np.zeros((size, 3)), (met - pairs) / windows]
        for f in range(n_features):
            for k in range(3):
                slopes[0][:, k] += np.bincount(flat[:, f], weights=over[:, k], minlength=size)
        slopes[0] = slopes[0] / windows + keep * theta[0]
        slopes[1][O, I] = 0
        for i in (0, 1):  # Adam
            moved[0][i] = 0.9 * moved[0][i] + 0.1 * slopes[i]
            moved[1][i] = 0.999 * moved[1][i] + 0.001 * slopes[i] ** 2
            theta[i] = theta[i] - rate * (moved[0][i] / (1 - 0.9**t)) / (np.sqrt(moved[1][i] / (1 - 0.999**t)) + 1e-8)
    return Field(*theta)


def silent() -> Field:
    """A field that tags nothing: only the base patterns find secrets with it."""
    moves = np.full((3, 3), -50.0)
    moves[:, O] = 0.0
    return Field(np.zeros((int(sum(SIZES)), 3)), moves)


#: Forms of secrets and of look-alikes that training texts get; tests leave some out.
FORMS = ("hex", "base62", "base64", "access", "prefixed", "dashed", "jwt", "human", "uuid")
_NAMES = ("password", "passwd", "pwd", "pass", "passphrase", "secret", "client_secret", "secret key", "token", "access token", "auth token", "api key", "apikey", "api-key", "API_KEY", "private key", "credential", "session key", "signing key", "webhook secret", "encryption key", "login", "pin code")


def _any(r: random.Random, letters: str, least: int, most: int) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(least, most)))


def value(r: random.Random, form: str) -> str:
    """A made-up secret of a form."""
    alnum, low = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    if form == "hex":
        return _any(r, "0123456789abcdef" if r.random() < 0.7 else "0123456789ABCDEF", 16, 64)
    if form == "base62":
        return _any(r, alnum, 12, 44)
    if form == "base64":
        return _any(r, alnum + "+/", 20, 60) + "=" * r.randint(0, 2)
    if form == "access":
        return r.choice(("AKIA", "ASIA")) + _any(r, string.ascii_uppercase + string.digits, 16, 16)
    if form == "prefixed":
        return r.choice(("ghp_", "gho_", "sk_live_", "pk_test_", "sk-", "glpat-", "npm_")) + _any(r, alnum, 20, 40)
    if form == "dashed":
        return "-".join(_any(r, low, 5, 12) for _ in range(r.randint(2, 4)))
    if form == "jwt":
        return ".".join(("eyJ" + _any(r, alnum, 17, 30), _any(r, alnum, 20, 60), _any(r, alnum + "-_", 20, 43)))
    if form == "uuid":
        return "-".join(_any(r, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))
    word = _any(r, string.ascii_lowercase, 4, 8)
    return r.choice((word.title() + _any(r, string.digits, 2, 4) + r.choice("!$#"), word + _any(r, string.digits, 1, 4) + word, word + r.choice("_-.") + _any(r, low, 4, 8), _any(r, alnum + "!#%&", 9, 16)))


def planted(r: random.Random, forms: tuple[str, ...]) -> tuple[str, str, str]:
    """What stands before a secret, the secret, and what stands behind it."""
    form = r.choice(forms)
    secret, name = value(r, form), r.choice(_NAMES)
    name = r.choice((name, name, name.upper(), name.title(), name.replace(" ", "_")))
    bare = form in ("access", "prefixed", "jwt")
    if bare and r.random() < 0.3:
        return "", secret, ""
    if r.random() < 0.15 and form not in ("human", "uuid", "dashed"):
        return r.choice(("Authorization: Bearer ", "authorization: bearer ", "Bearer ")), secret, ""
    quote = r.choice(("", "", '"', "'"))
    return name + r.choice((": ", "=", " = ", ":", " := ", " is ", ' -> ', '": ' if quote == '"' else ": ")) + quote, secret, quote


def lookalike(r: random.Random) -> str:
    """Text that resembles a secret or its surroundings and is none."""
    hexes, digits, word = "0123456789abcdef", string.digits, _any(r, string.ascii_lowercase, 4, 9)
    return r.choice((
        f"commit {_any(r, hexes, 7, 40)}", f"sha256 {_any(r, hexes, 64, 64)}", f"checksum: {_any(r, hexes, 32, 32)}", f"revision {_any(r, hexes, 12, 12)}", f"#{_any(r, hexes, 6, 6)}", f"ISBN 978-{_any(r, digits, 1, 1)}-{_any(r, digits, 4, 4)}-{_any(r, digits, 4, 4)}-1",
        f"+{_any(r, digits, 2, 2)} {_any(r, digits, 3, 4)} {_any(r, digits, 6, 7)}", f"{_any(r, digits, 16, 16)}", f"20{_any(r, digits, 2, 2)}-0{_any(r, '123456789', 1, 1)}-1{_any(r, digits, 1, 1)}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{word}.{_any(r, digits, 1, 3)}@mail{_any(r, digits, 1, 2)}.example.com",
        f"https://www.{word}.org/{word}/{_any(r, digits, 2, 5)}", f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", f"INV-{_any(r, digits, 5, 8)}", f"img_{_any(r, digits, 4, 4)}.jpg", f"the token of {word}", f"a secret {word}", f"the password must be {word}", f"key: {word}",
        f"id: {value(r, 'uuid')}", word.upper(), word.title() + word.title(), f"{word}_{word}", f"order no {_any(r, digits, 6, 9)}", f"access to {word}", f"login page {r.randint(1, 99)}", f"{word}{_any(r, digits, 1, 2)}", f"tokens = {r.randint(1, 999)}", f"private {word}, session {r.randint(1, 30)}", f"{_any(r, digits, 1, 3)}.{_any(r, digits, 2, 2)}",
    ))


def base_spans(text: str, said: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns, in order."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower() if said is None else said
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def examples(texts: list[str], seed: int = 5, forms: tuple[str, ...] = FORMS, places: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `places` tokens cut from texts, and their tags: of three windows one gets a secret put in, one a look-alike,
    and one stays; what a base pattern finds by its value is a secret too."""
    r, pieces, marks = random.Random(seed), [], []
    for text in texts:
        for at in range(0, max(1, len(text) - 150), 300):
            piece, spans = text[at : at + 300], []
            choice = r.random()
            if choice < 0.66:
                to = r.choice([m.end() for m in re.finditer(r"\s", piece[:180])] or [0])
                before, secret, after = planted(r, forms) if choice < 0.33 else (lookalike(r), "", "")
                spans = [(to + len(before), to + len(before) + len(secret))] if secret else []
                piece = f"{piece[:to]}{before}{secret}{after}{r.choice((' ', chr(10), ', '))}{piece[to:]}"
            if choice < 0.33 or choice >= 0.66:  # a look-alike's own base match is none
                spans += [(ASSIGN.match(piece, s).start(2), e) if k == 0 else (s, e) for s, k, e in base_spans(piece)]
            pieces.append(piece.encode("utf-8", "replace"))
            marks.append([(len(piece[:s].encode("utf-8", "replace")), len(piece[:e].encode("utf-8", "replace"))) for s, e in spans])
    tokens = Tokens(pieces)
    tags = np.zeros(len(tokens.start), np.int64)
    for i, spans in enumerate(marks):
        for s, e in spans:
            inside = np.arange(*np.searchsorted(tokens.start, (tokens.begin[i] + s, tokens.begin[i] + e)))
            tags[inside] = I
            tags[inside[:1]] = B
    firsts = np.searchsorted(tokens.text, np.arange(len(pieces) + 1))
    at = np.array([a for a, b in zip(firsts, firsts[1:]) if b - a >= places], np.int64)
    some = at[:, None] + np.arange(places)
    told = tags[some]
    told[:, 1:][(told[:, 1:] == I) & (told[:, :-1] == O)] = B  # a window or a span's first token may start within a secret
    told[:, 0][told[:, 0] == I] = B
    return tokens.rows[some], told


def fit(docs: DataFrame, sample: int = 120, chars: int = 3000, seed: int = 5, forms: tuple[str, ...] = FORMS) -> Field:
    """A field trained on stretches of `chars` characters at most of `sample` texts, those of the smallest hashes of doc_id;
    the bound keeps what comes to the driver below a megabyte or two, and the fit to some seconds. The hashes are ranked without
    the texts, so that tasks send no text that is not taken. Without any text the look-alikes and secrets stand alone."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    most = docs.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = docs.where((h <= F.lit(most)) & (F.col("text") != "")).select(h.alias("h"), F.substring("text", 1, chars).alias("text")).orderBy("h", "text").limit(sample)
    texts = [row["text"] for row in picked.collect()]
    r = random.Random(seed)
    plain = ["\n".join(" ".join(_any(r, string.ascii_lowercase, 1, 9) for _ in range(9)) for _ in range(40)) for _ in range(max(0, 60 - len(texts)))]
    return train(*examples(texts + plain, seed, forms))


def scan(texts: list[str], field: Field, shortest: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, place of the kind, end) in code points for each text: the base spans, and the field's that touch none of them."""
    data = [t.encode("utf-8", "replace") for t in texts]
    tokens = Tokens(data)
    tags = field.decode(field.scores(tokens.rows), tokens.text)
    longest = np.zeros(len(texts) + 1, np.int64)
    np.maximum.at(longest, tokens.text, tokens.end - tokens.start)
    begins = np.flatnonzero(tags == B)
    goes_on = np.concatenate([tags[1:] == I, [False]])
    stops = np.flatnonzero((tags > O) & ~goes_on)
    own: dict[int, list] = {}
    for a, b in zip(begins.tolist(), stops[np.searchsorted(stops, begins)].tolist(), strict=True):
        own.setdefault(int(tokens.text[a]), []).append((int(tokens.start[a] - tokens.begin[tokens.text[a]]), int(tokens.end[b] - tokens.begin[tokens.text[a]])))
    out = []
    for i, (text, raw) in enumerate(zip(texts, data, strict=True)):
        low = raw.lower()
        named = longest[i] >= LEAST["access"] or any(w in low for w in ASSIGN_WORDS)  # else there is nothing for a base pattern
        found = base_spans(text, low) if named else []
        taken = [(s, e) for s, _, e in found]
        for a, b in own.get(i, ()):
            s = len(raw[:a].decode("utf-8", "replace"))
            e = s + len(raw[a:b].decode("utf-8", "replace"))
            if e - s >= shortest and all(e <= x or y <= s for x, y in taken):
                found.append((s, 3, e))
        out.append(sorted(found))
    return out


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans): for each row of docs the spans of its whole text, by start and then by kind (see KINDS), in code points,
    ends exclusive. The field is fitted on docs if none is given.

    A null or empty text has no spans; repeated rows give equal rows; an empty table gives no rows. Texts go through a task in
    runs of about a megabyte, a longer one alone. Other columns of docs are not read."""
    field = field or fit(docs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum([len(t.as_py() or "") for t in texts])
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20), side="right")))
                found = scan([t or "" for t in texts.slice(at, to - at).to_pylist()], field)
                spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at).cast(pa.int64()), spans], names=["doc_id", "spans"])
                at = to

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id long, spans {SPANS}")


def secret_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """find_secrets as counts and text: doc_id, n_assign, n_access, n_hex, base_sha256 of the base spans as kind:start:end joined
    by commas, and all spans joined likewise. Nulls, empty texts and repeats as there."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS[:3]]
    base = F.filter("spans", lambda x: x.kind != KINDS[3])
    return find_secrets(docs, field).select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
