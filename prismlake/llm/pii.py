"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to like tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted to, tokens of them at most, and the marginal that an added token needs.
SAMPLE, TOKENS, SURE = 20_000, 40_000, 0.5
#: Rounds of message passing at most, and how much of the old message stays in each.
ROUNDS, DAMPING = 30, 0.3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit that no digit precedes: other starts in a run of digits can't match where its first one doesn't.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NODE = re.compile(r"\S*[0-9@]\S*")
_EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ so that long runs of its letters cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlaps within a kind, in order; code points."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def _nodes(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the tokens that can be personal data: those with a digit or an @, without outer marks.

    Label 0 is none, else 1 and the kind of the first base span that the token overlaps. All other tokens have
    label 0 for sure; they part the chain.
    """
    out, k = [], 0
    for m in _NODE.finditer(text):
        s, e = m.span()
        while s < e and text[s] in _EDGE:
            s += 1
        while s < e and text[e - 1] in _EDGE:
            e -= 1
        while k < len(spans) and spans[k][2] <= s:
            k += 1
        label = next((x[1] + 1 for x in spans[k : k + 4] if x[0] < e and x[2] > s), 0)
        if s < e:
            out.append((s, e, label))
    return out


def _features(token: str) -> list[float]:
    digits, letters = sum(map(token.count, "0123456789")), sum(c.isalpha() for c in token)
    dots, parts = token.count("."), token.split(".")
    n = [digits == 0, digits < 3, 3 <= digits < 5, 5 <= digits < 8, 8 <= digits < 10, 10 <= digits < 14, 14 <= digits < 20, digits > 19]
    rest = [
        True, "@" in token, token[:1] == "+", "(" in token or ")" in token, "-" in token, "=" in token, "_" in token or "%" in token, letters == 0, letters > digits,
        dots == 0, dots == 1, dots == 2, dots == 3, dots > 3, len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts),
        letters == 0 and 14 <= digits <= 19 and luhn("".join(re.findall("[0-9]", token))), "@" in token and "." in token.rpartition("@")[2],
    ]
    return [float(x) for x in n + rest]


_WIDTH = len(_features("1"))


def _key(token: str) -> str:
    """Like tokens have equal keys: the part before an @, the last seven digits of tokens with as many and no letter, else the lowered letters and digits."""
    local = token.partition("@")[0]
    if local != token and local:
        return local.lower() + "@"
    digits = "".join(_DIGIT.findall(token))
    return digits[-7:] if len(digits) > 6 and not any(c.isalpha() for c in token) else "".join(c for c in token.lower() if c.isalnum() or c in "@+")


def _weakened(text: str, kind: int) -> str:
    """The span's text as it may be repeated in a form that no fixed pattern knows: the host alone, other marks between digits, no country code."""
    if kind == 0:
        local, _, host = text.partition("@")
        return f"{local}@{host.split('.')[0]}"
    if kind == 1:
        return text.replace(".", "-")
    if kind == 2:
        return "/".join(re.split("[ -]", text)) if re.search("[ -]", text) else f"{text[:4]}/{text[4:]}"
    last = text.split()[-1]
    return last if last != text and len(_DIGIT.findall(last)) > 6 else "".join(_DIGIT.findall(text))[-10:]


def _mirrored(token: str) -> str:
    """The token with its letters and digits in reverse, marks in their places."""
    back = [c for c in token if c.isalnum()]
    return "".join(back.pop() if c.isalnum() else c for c in token)


def _edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links (neighbours with nothing but marks and white space between) and skip links (next like token)."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if not any(c.isalnum() for c in text[nodes[i][1] : nodes[i + 1][0]])]
    last, skip = {}, []
    for i, (s, e, _) in enumerate(nodes):
        key = _key(text[s:e])
        if len(key) > 4:  # shorter ones are alike by chance
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


@dataclass
class Field:
    """Log potentials: of a token's features and label, of neighbours' labels, and of like tokens' labels."""

    own: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, x: np.ndarray, label: np.ndarray, chain: list, skip: list) -> np.ndarray:
        """Of each token's labels, by loopy sum-product; tokens with a base label keep it."""
        k = self.own.shape[1]
        alone = np.where((label[:, None] > 0) & (np.arange(k)[None, :] != label[:, None]), -50.0, x @ self.own)
        a = np.array([e[0] for e in chain + skip], "i8")
        b = np.array([e[1] for e in chain + skip], "i8")
        weight = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(src), k))
        for _ in range(ROUNDS):
            belief = alone.copy()
            np.add.at(belief, dst, message)
            new = np.logaddexp.reduce((belief[src] - message[back])[:, :, None] + weight, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            moved = np.abs(new - message).max(initial=0)
            message = DAMPING * message + (1 - DAMPING) * new
            if moved < 1e-4:
                break
        belief = alone.copy()
        np.add.at(belief, dst, message)
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def _train(x: np.ndarray, chain: np.ndarray, skip: np.ndarray, y: np.ndarray, rounds: int = 1500, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Largest pseudo-likelihood: each token's label given its features and the labels beside it (counts by label)."""
    k = len(KINDS) + 1
    z = np.concatenate([x, chain, skip], 1)
    w, speed = np.zeros((z.shape[1], k)), np.zeros((z.shape[1], k))
    want = np.eye(k)[y]
    for _ in range(rounds if len(z) else 0):
        s = z @ w
        p = np.exp(s - np.logaddexp.reduce(s, axis=1, keepdims=True))
        speed = 0.9 * speed + z.T @ (want - p) / len(z) - decay * w
        w += rate * speed
    pair = lambda m: (m + m.T) / 2
    return Field(w[:_WIDTH], pair(w[_WIDTH : _WIDTH + k]), pair(w[_WIDTH + k :]))


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, tokens: int = TOKENS) -> Field:
    """The field, fitted to a bounded sample: about ``sample`` documents by id hash, ``tokens`` of their tokens.

    Labels are those of the base patterns. As the patterns tell them by the token alone, every other span is
    repeated behind the text in a form that no pattern knows, with the label of the span, and the others so, but
    with their letters and digits mirrored and no label: there only the skip link tells the label, so its
    potentials are learnt from what they are for.
    """
    n = docs.count()
    part = docs.where(F.shiftrightunsigned(F.xxhash64(doc_id), 2) <= int(min(1.0, sample / max(1, n)) * 2**62) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, t in zip(b["h"], b["t"], strict=True):
                t = t or ""
                spans = base_spans(t)
                for i, (s, k, e) in enumerate(list(spans)):
                    weak, same = _weakened(t[s:e], k), (h + i) % 2 == 0
                    weak = weak if same else _mirrored(weak)
                    if not base_spans(f" {weak} "):
                        spans += [(len(t) + 3, k, len(t) + 3 + len(weak))] * same
                        t += f" x {weak}"
                nodes = _nodes(t, sorted(spans))
                chain, skip = _edges(t, nodes)
                beside = np.zeros((2, len(nodes), len(KINDS) + 1))
                for side, links in enumerate((chain, skip)):
                    for i, j in links:
                        beside[side, i, nodes[j][2]] += 1
                        beside[side, j, nodes[i][2]] += 1
                out += [(h, i, lab, [*_features(t[s:e]), *beside[0, i], *beside[1, i]]) for i, (s, e, lab) in enumerate(nodes)]
            yield pd.DataFrame(out, columns=["h", "i", "label", "x"])

    rows = part.select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("t")).mapInPandas(run, "h long, i int, label int, x array<double>")
    got = rows.orderBy("h", "i").limit(tokens).collect()
    k = len(KINDS) + 1
    z = np.array([r["x"] for r in got], "f8").reshape(-1, _WIDTH + 2 * k)
    return _train(z[:, :_WIDTH], z[:, _WIDTH : _WIDTH + k], z[:, _WIDTH + k :], np.array([r["label"] for r in got], "i8"))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, sure: float = SURE) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the field adds: tokens outside base spans that it labels, joined to a base span's token by skip links.

    Texts without such links need no message passing, since only they can add anything. Neighbours that are added
    with one kind make one span.
    """
    if not base:
        return []
    nodes = _nodes(text, base)
    chain, skip = _edges(text, nodes)
    near: dict[int, set[int]] = {i: {lab} if lab else set() for i, (_, _, lab) in enumerate(nodes)}
    for i, j in [*skip, *reversed(skip)]:
        near[i] = near[j] = near[i] | near[j]
    if not any(near[i] for i, (_, _, lab) in enumerate(nodes) if not lab):
        return []
    label = np.array([x[2] for x in nodes])
    m = field.marginals(np.array([_features(text[s:e]) for s, e, _ in nodes]), label, chain, skip)
    out, linked = [], set(chain)
    for i, (s, e, lab) in enumerate(nodes):
        top = int(m[i].argmax())
        if lab or not top or m[i, top] < sure or top not in near[i]:
            continue
        if out and out[-1][3] == i - 1 and out[-1][1] == top - 1 and (i - 1, i) in linked:
            out[-1] = (out[-1][0], top - 1, e, i)
        else:
            out.append((s, top - 1, e, i))
    return [x[:3] for x in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str | None, field: Field) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    base = base_spans(text or "")
    spans = sorted(base + added_spans(text or "", base, field))
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_personal(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, n_added and spans of each row of docs.

    Spans are code points of the whole text, end exclusive, as kind:start:end by start, then kind, comma-joined;
    ``spans`` has the base spans and those that the field adds. A null text is empty and has none; repeated rows
    come out as often as they come in. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                base = base_spans(t or "")
                more = added_spans(t or "", base, held.value)
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), len(more), joined(base + more)))
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "spans"]
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    out = rows.mapInPandas(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_added long, spans string")
    return out.withColumnRenamed("id", doc_id)


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with personal data replaced in ``text``; null stays null, all other columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, held.value))

    return docs.withColumn(text, run(F.col(text)))


def op6_personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal(docs, fit(docs))
