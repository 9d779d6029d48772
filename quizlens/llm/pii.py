"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans (e-mail, IP, card, phone), which always stay. The field's nodes are all words of a document:
neighbours are linked as a chain, and distant mentions that repeat or resemble each other (equal letters and digits,
equal last digits of a number, parts of an address, groups of a card, numbers spelled out or split over words) are
linked by skip edges. Words inside base spans are observed; loopy message passing carries labels over the edges until
messages converge, so a short, split or disguised mention gets the label of the full one, wherever it
stands, and a disguised mention whose own shape and neighbours tell enough is found without one. A fifth label, secret,
has no pattern: it is for keys and passwords that are told by their context, and for their other mentions.

Each mention is linked to the first observed one of each label, so all have the same evidence, however many there are;
mentions of data that is never observed are linked to the one before.

Words without digit, @ or cue all have the same features. Far from other words their messages are those of an endless
plain text, which are computed once; ``Field.reach`` is the number of plain words after which no message can
differ from these by CONVERGED. So messages are passed among the other words and ``reach`` neighbours on
each side, and the result is that of the whole field.

The field's weights are trained by pseudo-likelihood on labelled documents drawn from templates (``examples``), the
same for any input; nothing is learned from the corpus, so results do not depend on its size.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; base spans of one
kind never overlap, those of different kinds may; added spans touch no base span; repeated rows give a row each. Time
is in proportion to a text's length, unbroken runs included; a kernel's memory is, to that of its longest text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, extended, kernel_slices, narrow, workspace

KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
LABELS = ("O", *FOUND)
#: Probability from which on the field adds a span.
SURE = 0.9
#: Messages that change by less than this have converged; where loops keep them moving, each DAMP_AFTER rounds halve the step.
CONVERGED = 1e-4
DAMP_AFTER = 40
#: Words whose class a worker remembers.
REMEMBERED = 300_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where digits begin
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_MAYBE = re.compile(r"[0-9@]")
_EDGE = re.compile(r"^[^\w+(@]+|[^\w)]+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost matches, found from each @: what may stand before it is one run, read backward once."""
    low, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[low:at][::-1]).end()
        host = _HOST.match(text, at + 1) if local else None
        if host:
            yield "email", at - local, host.end()
        low = host.end() if host else at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then by start."""
    out = []
    if "@" in text:
        out += _emails(text)
    if _MAYBE.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ---- the field: words -------------------------------------------------------------------------------------------

NUMBER_WORDS = {w: str(i % 10) for i, w in enumerate(["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh"])}
AT = {"at", "(at)", "[at]", "{at}", "arobase"}
DOT = {"dot", "(dot)", "[dot]", "{dot}", "punkt", "punto"}
CUES = (
    {"email", "e-mail", "mail", "mailto", "contact"},
    {"ip", "host", "server", "address"},
    {"card", "visa", "mastercard", "karte", "carte", "tarjeta"},
    {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"},
    {"token", "password", "passwd", "secret", "key", "api_key", "apikey", "api-key", "access_key", "passwort"},
)
_TOPS = {"com", "org", "net", "edu", "example", "de", "fr", "es"}
_CUE_WORDS = frozenset().union(*CUES)
_WORDS = frozenset([*NUMBER_WORDS, *_CUE_WORDS, *DOT, *AT]) - {"at"}
_SEVEN = re.compile(r"[0-9]{3}[-. ]?[0-9]{4}").fullmatch
_TEN = re.compile(r"(?:1[-. ])?[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}").fullmatch
_AREA_CODE = re.compile(r"\([0-9]{3}\)").fullmatch
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}").fullmatch
_DASHED_QUAD = re.compile(r"[0-9]{1,3}(?:-[0-9]{1,3}){3}").fullmatch
_KEYLIKE = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}").fullmatch
_PIECE = re.compile(r"\(?[0-9]{1,4}\)?").fullmatch
_SIGN = re.compile(r"[-–./·,]{1,2}").fullmatch


def _core(token: str) -> str:
    return _EDGE.sub("", token)


def _telling(token: str) -> bool:
    """Whether a word has features of its own."""
    low = token.casefold()
    if token.isalpha():
        return low in _WORDS
    if _MAYBE.search(token):
        return True
    core = _core(low)
    return core in _WORDS or low in _WORDS


class _Telling(dict):
    def __missing__(self, token: str) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found = _telling(token)
        return found


_PLAIN = 0  # features by name are numbered from 1; a plain word has this one alone


def _shape(core: str, low: str) -> list[int]:
    """Numbers of the features of a telling word by itself."""
    digits = _NOT_DIGIT.sub("", core)
    letters = any(c.isalpha() for c in core)
    n = 0 if letters else len(digits)
    on = [
        (1, "@" in core),
        (2, letters),
        (3, not digits),
        (4, 0 < n <= 2),
        (5, 2 < n <= 4),
        (6, 4 < n <= 8),
        (7, 8 < n <= 12),
        (8, 12 < n <= 19),
        (9, n > 19),
        (10, core[:1] == "+"),
        (11, core[:1] == "("),
        (12, bool(_QUAD(core)) and all(map(_small, core.split(".")))),
        (13, bool(_SEVEN(core))),
        (14, core.count("-") >= 2),
        (15, 12 < n <= 19 and luhn(digits)),
        (16, low in NUMBER_WORDS or core.casefold() in NUMBER_WORDS),
        (17, low in DOT or low in AT),
        (18, bool(_KEYLIKE(core))),
        (19, letters and digits != "" and "." in core),
        (20, letters and 0 < len(digits) <= 4),
        (26, bool(_TEN(core))),
        (27, bool(_DASHED_QUAD(core)) and all(map(_small, core.split("-")))),
        *((21 + k, core.casefold() in words) for k, words in enumerate(CUES)),
    ]
    return [k for k, yes in on if yes]


#: Features of a word from what stands beside it: sign or word between numbers, "at" or "dot" beside such or a telling
#: word, end of a spelled address; a key's cue up to two words before; a cue of a number before; a word beside "at"
#: or "dot"; part of a number of 7 to 9 or of more digits said in several words; beside an area code, or one.
_BETWEEN, _JOINS, _TOP, _CUED, _CALLED, _BESIDE_AT, _BESIDE_DOT, _SOME, _MANY, _AREA = range(28, 38)
N_FEATURES = 38


class Graph:
    """Words of many documents with chain and skip edges; ``observed`` is a label or -1.

    ``reach``: plain words on each side of others that are nodes (None: all words are). ``open_left``, ``open_right``
    mark nodes beside which the plain text goes on.
    """

    def __init__(self, reach: int | None = None) -> None:
        self.reach = reach
        self.rows: list[list[int]] = []  # numbers of the features that are on
        self.observed: list[int] = []
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.open_left: list[int] = []
        self.open_right: list[int] = []
        self.telling = workspace("telling", _Telling)

    def add(self, doc: int, text: str, base: list[tuple[str, int, int]]) -> None:
        words = text.split()
        n = len(words)
        telling = np.fromiter(map(self.telling.__getitem__, words), bool, n)
        where = np.flatnonzero(telling)
        if self.reach is None:
            taken = np.arange(n)
        elif not len(where):
            return  # an endless plain text
        else:
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, np.maximum(where - self.reach, 0), 1)
            np.add.at(step, np.minimum(where + self.reach + 1, n), -1)
            taken = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        places = [m.span() for m in _TOKEN.finditer(text)]
        chosen = set(taken.tolist())
        node = {}  # word's number to node
        for i in taken.tolist():
            node[i] = len(self.spans)
            core = _core(words[i]) or words[i]
            start = places[i][0] + words[i].find(core)
            self.spans.append((doc, start, start + len(core)))
            self.observed.append(-1)
            if i - 1 in node:
                self.chain.append((node[i - 1], node[i]))
            elif i:
                self.open_left.append(node[i])
            if i + 1 < n and i + 1 not in chosen:
                self.open_right.append(node[i])
        begins, ends = [p[0] for p in places], [p[1] for p in places]
        for kind, a, b in sorted(base, key=lambda s: s[1]):
            for i in range(bisect_right(ends, a), bisect_left(begins, b)):
                if self.observed[node[i]] < 0:
                    self.observed[node[i]] = LABELS.index(kind)
        self._describe(words, telling, node)
        self._link(words, telling, node)

    def _describe(self, words: list[str], telling: np.ndarray, node: dict[int, int]) -> None:
        low = {i: words[i].casefold() for i in node}
        core = {i: _core(x) or x for i, x in low.items()}
        get = low.get
        number = {i: NUMBER_WORDS.get(core[i]) or (core[i].strip("()") if _PIECE(core[i]) else "") for i in node if telling[i]}
        joins = {i for i in node if get(i) in DOT or (low[i] in AT and (low[i] != "at" or any(get(i + k) in DOT for k in (2, 3, 4))))}
        between = {i for i in node if (i in joins or _SIGN(words[i])) and number.get(i - 1) and number.get(i + 1)}
        on = {i: _shape(words[i][(a := words[i].find(_core(words[i]))) : a + len(_core(words[i]))] or words[i], low[i]) if telling[i] else [] for i in node}
        for i in node:
            more = on[i]
            if i in between:
                more.append(_BETWEEN)
            if i in joins and (i - 1 in node and telling[i - 1] or i + 1 in node and telling[i + 1] or get(i + 2) in DOT):
                more.append(_JOINS)
            if core[i] in _TOPS and get(i - 1) in DOT:
                more.append(_TOP)
            if len(core[i]) >= 8 and (core.get(i - 1) in CUES[4] or (get(i - 1) in (":", "=", ":=", "is") and core.get(i - 2) in CUES[4]) or core[i].partition("=")[0].partition(":")[0] in CUES[4]):
                more.append(_CUED)
            if number.get(i) and (core.get(i - 1) in CUES[3] or core.get(i - 2) in CUES[3]):
                more.append(_CALLED)
            if _AREA_CODE(core[i]) and _SEVEN(core.get(i + 1, "")) or _SEVEN(core[i]) and _AREA_CODE(core.get(i - 1, "")):
                more.append(_AREA)
            if i - 1 in joins and get(i - 1) in AT or i + 1 in joins and get(i + 1) in AT:
                more.append(_BESIDE_AT)
            if i - 1 in joins and get(i - 1) in DOT or i + 1 in joins and get(i + 1) in DOT:
                more.append(_BESIDE_DOT)
        self.runs: list[tuple[list[int], str]] = []  # numbers said in several words: the words and their digits
        run: list[int] = []
        for i in [*node, None]:
            if run and (i is None or i != run[-1] + 1 or not (number.get(i) or i in between)):
                digits = "".join(number.get(k, "") for k in run)
                said = [k for k in run if number.get(k)]
                quad = len(said) == 4 and len(run) == 7 and all(_small(number[k]) for k in said)
                if len(said) > 1 and (7 <= len(digits) <= 19 or quad):
                    self.runs.append((said, digits))
                    for k in run:
                        on[k] += [_MANY if len(digits) > 9 else _SOME] * (len(digits) > 6) + [12] * (quad and 12 not in on[k]) + [15] * (15 not in on[k] and 12 < len(digits) <= 19 and luhn(digits))
                run = []
            if i is not None and number.get(i):
                run.append(i)
            elif run and i in between:
                run.append(i)
        self.rows += [on[i] or [_PLAIN] for i in node]

    def _link(self, words: list[str], telling: np.ndarray, node: dict[int, int]) -> None:
        same: dict[tuple[str, str], list[int]] = defaultdict(list)
        keys: dict[int, set[tuple[str, str]]] = defaultdict(set)
        for i, k in node.items():
            if not telling[i]:
                continue
            core = _core(words[i]).casefold()
            digits = _NOT_DIGIT.sub("", core)
            keys[k].add(("t", "".join(c for c in core if c.isalnum())))
            if "@" in core or "=" in core:
                for part in re.split("[@=]", core):
                    keys[k].add(("t", "".join(c for c in part.strip("\"'") if c.isalnum())))
            if len(digits) >= 7 and len(digits) * 2 > len(core):
                keys[k].add(("d", digits[-7:]))
            if 12 < len(digits) <= 19:
                keys[k] |= {("g", digits[j : j + 4]) for j in (0, 4, 8, 12)}
            elif len(digits) == 4 == len(core):
                keys[k].add(("g", digits))
        for said, digits in self.runs:
            for i in said:
                keys[node[i]] |= {("d", digits[-7:]), ("t", digits)}
        for k in sorted(keys):
            for key in sorted(keys[k]):
                if len(key[1]) >= 4 and key[1] not in _WORDS:
                    same[key].append(k)
        told: set[int] = set()  # mentions linked to an observed one
        edges: set[tuple[int, int]] = set()
        for nodes in same.values():
            seen: dict[int, int] = {}  # the first mention observed with a label
            for k in nodes:
                if self.observed[k] >= 0:
                    seen.setdefault(self.observed[k], k)
            if seen:
                mentions = [k for k in nodes if self.observed[k] < 0]
                told.update(mentions)
                edges |= {(s, k) for k in mentions for s in seen.values()}
        for nodes in same.values():  # others are linked to the one before them, so edges grow with mentions
            nodes = [k for k in nodes if self.observed[k] < 0 and k not in told]
            edges |= {(a, b) for a, b in zip(nodes[:-1], nodes[1:], strict=True) if b - a > 1}
        self.skip += sorted(edges)

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.rows), N_FEATURES))
        for i, on in enumerate(self.rows):
            x[i, on] = 1
        x[:, _PLAIN] = [on == [_PLAIN] for on in self.rows]
        return x


# ---- the field: weights and messages ----------------------------------------------------------------------------


def _passed(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Messages over edges with potential exp ``pair`` from nodes with log beliefs ``x``, largest entry 0."""
    new = np.log(np.exp(x - x.max(axis=1, keepdims=True)) @ pair)
    return new - new.max(axis=1, keepdims=True)


class Field:
    """Weights: unary (features x labels), chain and skip (labels x labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip
        k = len(LABELS)
        plain = unary[_PLAIN]
        worst = np.where(np.eye(k) > 0, 0.0, -1e9)
        self.reach, self.endless = 0, []
        for pair in (np.exp(chain), np.exp(chain).T):  # messages from the left and from the right
            m, own = _passed(plain[None], pair), worst
            steps = 0
            while True:
                own = _passed(own, pair) + plain
                new = _passed(plain + m, pair)
                steps += 1
                done = np.abs(new - m).max() < 1e-9
                m = new
                if done and np.abs(_passed(own, pair) - m).max() < CONVERGED:
                    break
            self.reach = max(self.reach, steps + 1)
            self.endless.append(m[0])
        if (plain + self.endless[0] + self.endless[1]).argmax():
            raise ValueError("the field labels plain words")

    def marginals(self, graph: Graph, rounds: int | None = None) -> np.ndarray:
        """Beliefs of all nodes by loopy sum-product in log space, until messages converge or after ``rounds``."""
        n, k = len(graph.spans), len(LABELS)
        own = graph.matrix() @ self.unary
        own[graph.open_left] += self.endless[0]
        own[graph.open_right] += self.endless[1]
        seen = np.array(graph.observed, np.int64)
        own[seen >= 0] = -1e9  # more than the messages of any number of mentions
        own[seen >= 0, seen[seen >= 0]] = 0.0
        chain, skip = (np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip))
        # each kind of message: from, to, potential, place of the opposite one
        kinds = [(chain[:, 0], chain[:, 1], np.exp(self.chain), 1), (chain[:, 1], chain[:, 0], np.exp(self.chain).T, 0), (skip[:, 0], skip[:, 1], np.exp(self.skip), 3), (skip[:, 1], skip[:, 0], np.exp(self.skip).T, 2)]
        messages = [np.zeros((len(src), k)) for src, *_ in kinds]

        def total() -> np.ndarray:
            out = own.copy()
            for (_, dst, _, _), m in zip(kinds[:2], messages[:2], strict=True):
                out[dst] += m  # a word has one neighbour on each side
            for (_, dst, _, _), m in zip(kinds[2:], messages[2:], strict=True):
                np.add.at(out, dst, m)
            return out

        for turn in count():
            step = 1.0 / 2 ** (turn // DAMP_AFTER)
            at, change = total(), 0.0
            new = [_passed(at[src] - messages[back], pair) if len(src) else messages[i] for i, (src, _, pair, back) in enumerate(kinds)]
            for i, m in enumerate(new):
                if len(m):
                    change = max(change, step * float(np.abs(m - messages[i]).max()))
                    messages[i] = (1 - step) * messages[i] + step * m
            if change < CONVERGED or turn + 1 == rounds:
                break
        own = total()
        own -= own.max(axis=1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(axis=1, keepdims=True)


_SAID = [w for w in NUMBER_WORDS if w != "oh"]


def examples(n: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Labelled documents from templates: text, spans visible as base, all spans. Forms that could as well be something
    else are personal data only where the full form stands in the same document."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    said = lambda d: " ".join(_SAID[int(c)] for c in d)
    filler = lambda: " ".join(r.choice(["then", "she", "wrote", "again", "about", "it", "and", "we", "left", "—", "at", "home,", "mail", "address"]) for _ in range(r.randint(2, 6)))

    def card(real: bool) -> str:
        while True:
            if luhn(d := digits(16)) == real:
                return d

    def junk() -> str:
        return r.choice([lambda: f"item {digits(5)}", lambda: card(False), lambda: f"{digits(1)}.{digits(1)}.", lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}.{digits(3)}9", lambda: f"{digits(3)}-{digits(4)}", lambda: f"({digits(3)})", lambda: digits(10), lambda: f"@{digits(2)}user", lambda: f"{digits(2)} | {digits(3)} | {digits(2)} | {digits(1)}", lambda: f"{digits(2)}-{digits(2)}-{digits(3)}-{digits(1)}", lambda: f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", lambda: f"{digits(4)} / {digits(4)}", lambda: said(digits(r.randint(1, 3))), lambda: f"at {digits(2)} dot", lambda: f"mail{digits(1)}", lambda: f"ann.{digits(2)}", lambda: "20" + digits(2), lambda: f"x = {digits(3)}", lambda: f"name = \"ann{digits(2)}\"", lambda: f"{digits(2)}:{digits(2)}"])()

    out = []
    for _ in range(n):
        parts: list[tuple[str, str, bool]] = []  # text, label, visible
        for _ in range(r.randint(1, 3)):
            kind = r.choice(FOUND)
            # the full form, forms that tell what they are, forms that need the full one
            if kind == "email":
                name, host = f"{r.choice(['ann', 'bo', 'kim', 'lee'])}.{digits(2)}", f"mail{digits(1)}.example"
                at, dot = r.choice(["at", "(at)", "[at]"]), r.choice(["dot", "(dot)", "[dot]"])
                spelled = host.replace(".", f" {dot} ")
                full, clear, vague = f"{name}@{host}.com", [f"{name} {at} {spelled} {dot} com", f"{name} {r.choice(['(at)', '[at]'])} {host}.com", f"{name}@{host}"], [name]
            elif kind == "ip":
                p = [str(r.randint(1, 255)) for _ in range(4)]
                full, clear, vague = ".".join(p), [" dot ".join(p), " . ".join(p)], ["-".join(p)]
            elif kind == "card":
                c = card(True)
                groups = [c[i : i + 4] for i in range(0, 16, 4)]
                full, clear, vague = c, [" / ".join(groups), ".".join(groups), said(c), f"#{c[:8]}.{c[8:]}", " . ".join(groups)], [c[8:]]
            elif kind == "phone":
                a, b, c = digits(3), digits(3), digits(4)
                full, clear, vague = f"+1 ({a}) {b}-{c}", [f"({a}) {b}-{c}", f"1-{a}-{b}-{c}", said(a + b + c), f"call {a} {b} {c}", f"tel: {a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} - {b} - {c}"], [f"{b}-{c}", said(b + c)]
            else:
                letters = r.choice(["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
                k = "".join(r.choice(letters) for _ in range(r.choice([20, 32, 40])))
                cue = r.choice(sorted(CUES[4]))
                full, clear, vague = f'{cue} = "{k}"', [f"{cue}: {k}", f"{cue} {k}", f"{cue}={k}"], [k, f"({k})"]
            seen = r.random() < 0.6
            if kind == "secret":
                shown = [full if seen else r.choice(clear)]
                shown += [f for f in vague if r.random() < 0.5]
            else:
                shown = [full] * seen + [f for f in clear if r.random() < 0.5]
            parts += [(f, kind, f == full and kind != "secret") for f in shown]
            parts += [(f, kind if shown else "O", False) for f in vague if r.random() < 0.7 and kind != "secret"]
        parts += [(junk(), "O", False) for _ in range(r.randint(2, 8))]
        if r.random() < 0.5:
            parts += [(junk(), "O", False)] * 2
        r.shuffle(parts)
        text, spans, base = "", [], []
        for piece, kind, visible in parts:
            text += filler() + " " if r.random() < 0.8 else ""
            if kind != "O":
                lead = re.match(r"(?:call |tel: |[a-z_-]+ ?[=:]? ?\"?(?=[0-9A-Za-z]{20,}))?", piece).end() if kind in ("phone", "secret") else 0
                spans.append((kind, len(text) + lead, len(text) + len(piece)))
                if visible:
                    base.append(spans[-1])
            text += piece + " "
        out.append((text, base, spans))
    return out


def train(docs=None, rounds: int = 800) -> Field:
    """Weights that maximise the pseudo-likelihood of the examples' labels, with a small L2 penalty."""
    graph, truth = Graph(), []
    for d, (text, base, spans) in enumerate(docs or examples()):
        before = len(graph.spans)
        graph.add(d, text, base)  # with the links that mentions have where they are looked for
        for _, a, b in graph.spans[before:]:
            truth.append(LABELS.index(next((k for k, x, y in spans if x < b and y > a), "O")))
    n, k = len(truth), len(LABELS)
    y = np.eye(k)[truth]
    chain, skipped = (np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip))
    left, right, skip = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))  # labels of a word's neighbours
    left[chain[:, 1]], right[chain[:, 0]] = y[chain[:, 0]], y[chain[:, 1]]
    np.add.at(skip, skipped[:, 1], y[skipped[:, 0]])
    np.add.at(skip, skipped[:, 0], y[skipped[:, 1]])
    rows, times = np.unique(np.concatenate([graph.matrix(), left, right, skip, y], axis=1), axis=0, return_counts=True)
    x, left, right, skip, y = np.split(rows, np.cumsum([N_FEATURES, k, k, k]), axis=1)
    times = times[:, None]
    chain_w, skip_w, unary = np.zeros((k, k)), np.zeros((k, k)), np.zeros((N_FEATURES, k))
    params, m, v = np.concatenate([unary.ravel(), chain_w.ravel(), skip_w.ravel()]), 0.0, 0.0
    for t in range(1, rounds + 1):
        unary, chain_w, skip_w = params[: unary.size].reshape(unary.shape), params[unary.size : unary.size + k * k].reshape(k, k), params[unary.size + k * k :].reshape(k, k)
        s = x @ unary + left @ chain_w + right @ chain_w.T + skip @ (skip_w + skip_w.T) / 2
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        err = (p / p.sum(axis=1, keepdims=True) - y) * times
        g_skip = skip.T @ err
        g = np.concatenate([(x.T @ err).ravel(), (left.T @ err + err.T @ right).ravel(), ((g_skip + g_skip.T) / 2).ravel()]) / n + 3e-6 * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        params = params - 0.3 / (1 + t / 200) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(unary, chain_w, (skip_w + skip_w.T) / 2)


def added_spans(field: Field, texts: list[str], bases: list[list[tuple[str, int, int]]], sure: float = SURE) -> list[list[tuple[str, int, int]]]:
    """What the field adds to the base spans of each text; neighbouring words of one label form one span."""
    graph = Graph(field.reach)
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        graph.add(d, text, base)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not graph.spans:
        return out
    p = field.marginals(graph)
    label = p.argmax(axis=1)
    linked = {b: a for a, b in graph.chain}
    fresh = np.flatnonzero((label > 0) & (np.array(graph.observed) < 0) & (p[np.arange(len(p)), label] >= sure)).tolist()
    ends: dict[int, int] = {}
    for i in fresh:
        doc, start, end = graph.spans[i]
        kind = LABELS[label[i]]
        before = linked.get(i)
        if before in ends and label[before] == label[i]:
            slot = ends[before]
            out[doc][slot] = (kind, out[doc][slot][1], end)
            ends[i] = slot
        else:
            ends[i] = len(out[doc])
            out[doc].append((kind, start, end))
    return out


def spans_of(field: Field, texts: list[str]) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base spans and added spans of each text."""
    bases = [base_spans(t) for t in texts]
    return bases, added_spans(field, texts, bases)


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (FOUND.index(s[0]), s[1], s[2]))


# ---- the operator ----------------------------------------------------------------------------------------------

_OUT = "doc_id long, text string, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _as_rows(many: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in many], _SPAN)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans replaced by its kind in brackets; overlapping spans are one stretch."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def _with_spans(texts, base, added) -> dict[str, pa.Array]:
    return {"text": pa.array(texts, pa.string()), "base": _as_rows(base), "added": _as_rows(added)}


def _with_mask(texts, base, added) -> dict[str, pa.Array]:
    return {"text": pa.array([masked(t, [*b, *a]) for t, b, a in zip(texts, base, added, strict=True)], pa.string())}


def _with_digest(texts, base, added) -> dict[str, pa.Array]:
    counts = {f"n_{k}": pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS}
    every = [[*b, *a] for b, a in zip(base, added, strict=True)]
    digests = pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string())
    return {**counts, "base_sha256": digests, "spans": pa.array(map(_joined, every), pa.string()), "n_added": pa.array(map(len, added), pa.int64()), "n_spans": pa.array(map(len, every), pa.int64())}


def _finder(field: Field, columns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workspace("telling", _Telling)  # and nothing of earlier kernels
        for batch in batches:
            texts, base, added = batch["text"].to_pylist(), [], []
            for lo, hi in kernel_slices(texts):
                b, a = spans_of(field, texts[lo:hi])
                base += b
                added += a
            yield carried(batch, {"doc_id": batch["doc_id"], **columns(texts, base, added)})

    return run


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text, base and added spans; ``carry`` adds ``row``, the whole row of ``docs``."""
    given = narrow(docs, id_col, text_col, carry)
    return given.mapInArrow(_finder(field or train(), _with_spans), extended(given, _OUT))


def mask(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text with all spans masked; ``carry`` adds ``row``. Found and masked in one kernel."""
    given = narrow(docs, id_col, text_col, carry)
    return given.mapInArrow(_finder(field or train(), _with_mask), extended(given, "doc_id long, text string"))


def summary(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and how many are added and in all."""
    given = narrow(docs, id_col, text_col)
    return given.mapInArrow(_finder(field or train(), _with_digest), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
