"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
The field adds what they miss (other spellings of these, and secrets such as
tokens and keys): it scores whole candidate spans by features of the span (its
shape, digits, check sums) and of its neighbours, and chooses boundaries and
types of all spans of a region at once by dynamic programming over segments of
at most ``MAX_TOKENS`` tokens. Base spans stay; what overlaps one is not added.

It is fitted by maximum likelihood on sentences made here from a seed. A region is
a line that holds a digit or an at-sign. No candidate crosses the end of a line, and
without these signs there is none, so leaving the other lines out changes nothing.
Features see the tokens of the line. Lines of any length are decoded whole: spans
are scored some thousand tokens at a time, and only those that can win are kept.

Scale: each text is handled where it is read, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probegrid.llm.common import documents_of

KINDS = ["email", "ip", "card", "phone", "secret"]
MAX_TOKENS = 14
FEATURES = 1 << 12
SENTENCES = 700
EPOCHS = 5
#: A span is added if its score exceeds that of leaving its tokens out by this much.
MARGIN = 3.0

# fixed values: the base patterns; they match what the stated ones match, in linear time
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches; kinds may overlap each other."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, at + 1)  # no address holds this sign, nor begins before it
        at = text.find("@", done)
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


# --- the field -------------------------------------------------------------------

_TOKEN = re.compile(r"\w+|[^\w\s]")
_ANCHOR = re.compile(r"[0-9@]")
#: Tokens whose candidate spans are scored at a time.
SCORED = 2000


class Slots(dict):
    """Feature name -> weight row, remembered."""

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[name] = at = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES
        return at


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of each line with a digit or an at-sign; no candidate crosses the end of a line."""
    at = 0
    while m := _ANCHOR.search(text, at):
        start = text.rfind("\n", at, m.start()) + 1 or at
        end = text.find("\n", m.end())
        at = len(text) if end < 0 else end
        yield [t.span() for t in _TOKEN.finditer(text, start, at)]


def _shape(span: str) -> str:
    """Runs of digits, lower- and upper-case letters with their lengths up to 4, other characters as they are."""
    out = []
    for m in re.finditer(r"[0-9]+|[a-z]+|[A-Z]+|\s+|.", span):
        c, n = m[0][0], min(4, len(m[0]))
        out.append(f"d{n}" if c.isdigit() else f"a{n}" if c.islower() else f"A{n}" if c.isupper() else "_" if c.isspace() else c)
    return "".join(out)


def candidates(text: str, tokens: list[tuple[int, int]], begin: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """(first, last) of token runs that may be an entity, for first in [begin, stop).

    They hold a digit or an at-sign, end with a letter or digit, and have no gap but
    single blanks (plain or no-break): tabs and line ends part cells and records.
    """
    out = []
    for i in range(begin, len(tokens) if stop is None else min(stop, len(tokens))):
        a = tokens[i][0]
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        letters, digits, groups, signs = 0, 0, 1, 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            s, e = tokens[j]
            if j > i:
                gap = s - tokens[j - 1][1]
                if gap > 1 or gap == 1 and (text[s - 1] not in " \xa0" or letters and not signs):
                    break
                groups += gap
            word = text[s:e]
            if word in ("|", ",", ";", "\"", "'", "=", ":"):
                break
            letters += word.isalpha()
            signs += word == "@"
            digits += sum(c.isdigit() for c in word)
            if signs > 1:
                break  # no entity has two at-signs
            if text[e - 1].isalnum() and (digits or signs) and (groups == 1 or digits >= 2 * groups or signs):
                out.append((i, j))
    return out


def span_features(text: str, tokens: list[tuple[int, int]], first: int, last: int, slots: Slots) -> list[int]:
    a, b = tokens[first][0], tokens[last][1]
    span = text[a:b]
    digits = _digits(span)
    before = text[tokens[first - 1][0]:tokens[first - 1][1]].lower() if first else "^"
    cue = text[tokens[first - 2][0]:tokens[first - 2][1]].lower() if first > 1 else "^"
    after = text[tokens[last + 1][0]:tokens[last + 1][1]].lower() if last + 1 < len(tokens) else "$"
    parts = span.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    glued = (a > 0 and text[a - 1].isalnum(), b < len(text) and text[b].isalnum(), after in ("@", ".", "-") and b < len(text) and text[b] in "@.-" and b + 1 < len(text) and text[b + 1].isalnum(),
             before in ("@", ".", "-", "+") and a > 0 and text[a - 1] in "@.-+")
    hexa = len(span) >= 16 and all(c in "0123456789abcdefABCDEF" for c in span)
    names = [
        "one", f"n{last - first}", f"shape:{_shape(span)}", f"digits{min(20, len(digits))}", f"at{span.count('@')}", f"quad{quad}", f"luhn{14 <= len(digits) <= 19 and luhn(digits)}",
        f"hex{hexa}{min(4, len(span) // 16)}", f"alpha{any(c.isalpha() for c in span)}{min(5, len(span) // 8)}", f"glued{glued}", f"start:{span[0] if not span[0].isalnum() else 'd' if span[0].isdigit() else 'a'}",
        f"before:{before if not before.isdigit() else '#'}", f"cue:{cue}:{before}", f"after:{after if not after.isdigit() else '#'}", f"mix{any(c.isdigit() for c in span)}{any(c.islower() for c in span)}{any(c.isupper() for c in span)}{'.' in span}{'@' in span}",
    ]
    return [slots[x] for x in names]


class Field:
    """Weights of span features per kind; leaving a token out scores 0."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, len(KINDS)), dtype=np.float32) if weights is None else weights

    def segments(self, text: str, tokens: list[tuple[int, int]], slots: Slots, begin: int = 0, stop: int | None = None) -> tuple[list[tuple[int, int]], list[list[int]], np.ndarray]:
        runs = candidates(text, tokens, begin, stop)
        features = [span_features(text, tokens, i, j, slots) for i, j in runs]
        scores = np.array([self.weights[f].sum(axis=0) for f in features]).reshape(len(runs), len(KINDS))
        return runs, features, scores

    def decode(self, text: str, tokens: list[tuple[int, int]], slots: Slots | None = None) -> list[tuple[int, int, str]]:
        """The best labelling: (start, end, kind) of its spans."""
        slots = Slots() if slots is None else slots
        best = [0.0] * (len(tokens) + 1)
        back: list[tuple[int, int] | None] = [None] * (len(tokens) + 1)
        ending: dict[int, list[tuple[int, int, float]]] = {}
        for begin in range(0, len(tokens), SCORED):
            runs, _, scores = self.segments(text, tokens, slots, begin, begin + SCORED)
            top = scores.argmax(axis=1) if len(runs) else []
            for (i, j), k, s in zip(runs, top, scores, strict=True):
                if s[k] > MARGIN:
                    ending.setdefault(j, []).append((i, int(k), float(s[k]) - MARGIN))
        for j in range(len(tokens)):
            best[j + 1] = best[j]
            for i, k, s in ending.get(j, ()):
                if best[i] + s > best[j + 1]:
                    best[j + 1], back[j + 1] = best[i] + s, (i, k)
        out, at = [], len(tokens)
        while at:
            if back[at] and best[at] > best[at - 1]:
                i, k = back[at]
                out.append((tokens[i][0], tokens[at - 1][1], KINDS[k]))
                at = i
            else:
                at -= 1
        return out[::-1]

    def gradient(self, n: int, runs: list[tuple[int, int]], scores: np.ndarray, gold: set[tuple[int, int, int]]) -> np.ndarray:
        """Of the log-likelihood, by segment and kind: what the labelling has less what the field expects."""
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        total = np.logaddexp.reduce(scores, axis=1) if len(runs) else np.empty(0)
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for s, (i, j) in enumerate(runs):
            by_end.setdefault(j, []).append(s)
            by_start.setdefault(i, []).append(s)
        for j in range(n):
            forward[j + 1] = np.logaddexp.reduce([forward[j], *(forward[runs[s][0]] + total[s] for s in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[runs[s][1] + 1] + total[s] for s in by_start.get(i, ()))])
        out = np.zeros_like(scores)
        for s, (i, j) in enumerate(runs):
            out[s] = -np.exp(forward[i] + backward[j + 1] + scores[s] - forward[n])
            for k in range(len(KINDS)):
                if (i, j, k) in gold:
                    out[s, k] += 1.0
        return out


# --- sentences to learn from -----------------------------------------------------

def _card(r: random.Random) -> str:
    body = [r.randrange(10) for _ in range(15)]
    check = next(c for c in range(10) if luhn("".join(map(str, [*body, c]))))
    d = "".join(map(str, [*body, check]))
    return r.choice([d, " ".join(d[i:i + 4] for i in range(0, 16, 4)), "-".join(d[i:i + 4] for i in range(0, 16, 4))])


def _number(r: random.Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def _secret(r: random.Random) -> str:
    """A key as hexadecimal digits, in base 64, or letters and digits behind a prefix."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    signs, n, prefix = r.choice([
        (digits + "abcdef", r.choice([32, 40, 64]), ""), (digits + "abcdef", r.choice([32, 40, 64]), ""),
        (digits + lower + lower.upper() + "+/", r.choice([32, 40, 44, 64]), ""),
        (digits + lower + lower.upper(), r.choice([24, 32, 36]), r.choice(["sk_live_", "ghp_", "xoxb-", "key-", "pat_"])),
        (digits + lower.upper(), 16, r.choice(["AKIA", "ASIA"])),
    ])
    body = "".join(r.choice(signs) for _ in range(n - 2))
    return f"{prefix}{r.choice(signs[10:16])}{body}{r.choice(digits)}"


def _word(r: random.Random) -> str:
    return "".join(r.choice(["the", "on", "er", "an", "ti", "re", "ou", "en", "sch", "le", "ado", "ich", "mo", "ka"]) for _ in range(r.randint(1, 4)))


def sentence(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text and the entities in it."""
    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        text += " ".join(_word(r) for _ in range(r.randint(2, 5))) + r.choice([" ", " ", ". ", ", "])
        kind = r.choice([*KINDS, "none", "none", "none", "none"])
        lead = ""
        if kind == "email":
            value = f"{_word(r)}{r.choice(['', '.', '_', '+'])}{r.choice([_word(r), _number(r, 2)])}@{_word(r)}{r.choice(['', '9'])}.{r.choice(['com', 'org', 'example.net', 'de'])}"
            lead = r.choice(["", "", "mail "])
        elif kind == "ip":
            value = ".".join(str(r.randrange(256)) for _ in range(4))
            lead = r.choice(["", "", "from "])
        elif kind == "card":
            value, lead = _card(r), r.choice(["", "", "card "])
        elif kind == "phone":
            a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
            value = r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a})-{b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(20, 99)} {a} {b} {c}"])
            lead = r.choice(["", "", "phone ", "call "])
        elif kind == "secret":
            value = _secret(r)
            lead = r.choice(['token = "', 'token = "', "key: ", "secret=", 'key: "', '"', ""])
        else:
            value = r.choice([
                _number(r, r.randint(1, 13)), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 99)}.{_number(r, 2)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
                f"{r.randint(1, 12)}:{_number(r, 2)}", f"{_word(r)}{_number(r, 2)}", f"@{_word(r)}", f"{_number(r, 2)}/{_number(r, 2)}/{_number(r, 4)}", f"{_number(r, 1)},{_number(r, 3)}", f"{r.randint(1, 400)}-{r.randint(400, 900)}",
                f"{_number(r, 2)} {_number(r, 3)}", f"v{_number(r, 1)}.{_number(r, 1)}", _number(r, 20), f"#{_number(r, 5)}", f"{_word(r)} {_number(r, 4)} {_word(r)}",
                f"{_word(r)}_{_word(r)}_{_number(r, 2)}", f"{_word(r).title()}{_word(r).title()}{_number(r, 2)}", f"{_word(r)}/{_number(r, 4)}/{_word(r)}_{_word(r)}", f"{_word(r)}-{_number(r, 1)}.{_number(r, 1)}.{_number(r, 1)}.zip",
                f"{_word(r)}{_word(r)}{_word(r)}{_number(r, 3)}", f"{_word(r)[:3]}{_number(r, 2)}",
            ])
        text += lead
        if kind != "none":
            spans.append((len(text), len(text) + len(value), kind))
        text += value + ('"' if lead.endswith('"') else "") + r.choice([" ", ". ", ", ", ") ", "\n", " | ", "\t"])
    return text + _word(r), spans


@cache
def train(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = 11, rate: float = 0.4) -> Field:
    """The field, fitted by stochastic gradient ascent of the likelihood of made sentences."""
    r = random.Random(seed)
    field, data, slots = Field(), [], Slots()
    for _ in range(sentences):
        text, spans = sentence(r)
        for tokens in regions(text):
            runs, features, _ = field.segments(text, tokens, slots)
            at = {(tokens[i][0], tokens[j][1]): (i, j) for i, j in runs}
            gold = {(*at[a, b], KINDS.index(k)) for a, b, k in spans if (a, b) in at}
            data.append((len(tokens), runs, [np.array(f) for f in features], gold))
    squares = np.full_like(field.weights, 1e-2)
    for _ in range(epochs):
        r.shuffle(data)
        for n, runs, features, gold in data:
            scores = np.array([field.weights[f].sum(axis=0) for f in features], dtype=np.float64).reshape(len(runs), len(KINDS))
            for f, g in zip(features, field.gradient(n, runs, scores, gold), strict=True):
                if np.abs(g).max() > 1e-3:
                    squares[f] += g * g
                    field.weights[f] += rate * g / np.sqrt(squares[f])
    return field


# --- Spark -----------------------------------------------------------------------

def find_spans(text: str, field: Field, slots: Slots | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind as listed."""
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in taken]
    reach, high = [], 0
    for _, b in taken:
        high = max(high, b)
        reach.append(high)
    slots = Slots() if slots is None else slots
    added = []
    for tokens in regions(text):
        for a, b, k in field.decode(text, tokens, slots):
            i = bisect_left(starts, b)
            if i == 0 or reach[i - 1] <= a:
                added.append((a, b, k))
    order = {k: i for i, k in enumerate(KINDS)}
    by = lambda s: (s[0], order[s[2]], s[1])
    return sorted(base, key=by), sorted(set(base) | set(added), key=by)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, one row per row of ``docs``.

    Counts and digest are of the base spans; spans lists all, as kind:start:end in
    code points. Null counts as empty. Every row is judged by its own text; an empty
    table gives no rows.
    """
    field = field or train()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text, field, slots)
                kinds = [k for _, _, k in base]
                out.append([*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)])
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return documents_of(docs).mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
