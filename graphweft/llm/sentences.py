"""Sentence units of texts in any language and script."""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the tagger is fitted on, at most, and the longest text among them. Only the fit is bounded; every document is tagged whole.
TRAIN_DOCUMENTS = 4000
TRAIN_CHARS = 20_000
#: Rounds of the fit of the layout model and of the chain.
ROUNDS, PASSES = 300, 4
#: A place is a boundary in the first labels if it is at least this likely, against a place between two blocks.
LIKE_BLOCKS = 0.1
#: Penalty on the weights of the layout model, and places that a feature has to be seen at for a weight of its own there.
PENALTY, SEEN = 1e-4, 8
#: Score by which each true tag has to win in the fit of the chain.
MARGIN = 3.0
#: How much slower the chain learns moves between tags than features, which say more.
MOVE_STEP = 0.002
#: Blocks of its script that a block is joined to.
JOINED = 2
#: Share of the chains in which the fit hides the words, so that it also learns what forms of unknown words say.
HIDDEN = 0.2
#: Weight of the layout model in the weights that the fit of the chain starts from.
START = 2.0
#: What it starts from besides: forms of abbreviated names and titles before a capital, of which a corpus may hold none.
PRIOR = {"brief=initial": -40.0, "brief=initials": -40.0, "brief=title": -40.0}
#: Words that a task remembers the forms of.
REMEMBERED = 50_000
#: Characters on each side that the features of a place look at, besides its word.
LOOK = 64

OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "‹": "›"}
BRACKETS = frozenset("([{（【")
CLOSERS = frozenset(OPENERS.values()) | {'"'}
INVISIBLE = r"\s\x00-\x1f\x7f-\x9f­᠎​-‏‪-‮⁠-⁤﻿"
UNPUNCTUATED = r"฀-໿က-႟ក-៿"
WIDE = r"぀-ヿ㐀-䶿一-鿿豈-﫿"

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_VISIBLE = re.compile(rf"[^{INVISIBLE}]")
_ITEM = re.compile(rf"[{INVISIBLE}]*(?:[-*+•‣▪–—]|\d{{1,3}}[.)]|[a-zA-Z][)])[ \t\xa0]+(?=\S)")
_HEADING = re.compile(rf"[{INVISIBLE}]*#{{1,6}}[ \t]+\S")
_MARKS = re.compile(r"[.!?…‥。！？｡．।॥؟۔;;]+")
_STRONG = frozenset("。！？｡．।॥؟۔…")
_BLANK = re.compile(r"\s")
_PAIRED = re.compile(r"[\"“”„«»「」『』（）()\[\]{}【】《》〈〉‹›]")
_CLOSING = re.compile(r"(?:[\xa0 ]?»|[\"”“)\]}」』）】》〉›’'])*")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_NO_MARKS = re.compile(rf"[{UNPUNCTUATED}]")
_WIDE = re.compile(rf"[{WIDE}]")
_TOKEN = re.compile(r"(?:[^\s(\[{“„«「『（\"'‘’,]|(?<=\d),(?=\d))+")
_NUMBER = re.compile(r"\d[\d.,:]*")
_LEAD = re.compile(rf"\A[{INVISIBLE}]+")
_FOREIGN = re.compile(r"[^\W\d_a-zA-ZÀ-ɏ]")
_RUN = re.compile(r"\S+")

@dataclass
class Place:
    """A character after which a unit may end: ``end`` is the place after closing marks, ``start`` where the next visible one begins."""

    end: int
    start: int
    features: list[str]
    #: Which of the features name words.
    words: int


def lines(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line without its line end."""
    start = 0
    for m in _LINE.finditer(text):
        yield start, m.start()
        start = m.end()
    yield start, len(text)


def trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span from its first to its last visible character, if it has any."""
    first = _VISIBLE.search(text, start, end)
    if not first:
        return None
    while end > first.start() and not _VISIBLE.match(text, end - 1):
        end -= 1
    return first.start(), end


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans that no unit crosses: paragraphs, list items and headings."""
    out: list[tuple[int, int]] = []
    start, end, alone = -1, -1, False

    def close() -> None:
        if start >= 0:
            out.append((start, end))

    for a, b in lines(text):
        if not _VISIBLE.search(text, a, b):
            close()
            start = -1
            continue
        item, heading = _ITEM.match(text, a, b), _HEADING.match(text, a, b)
        if start < 0 or alone or item or heading:
            close()
            start = a
        end, alone = b, bool(item or heading)
    close()
    return out


def _pairs(block: str) -> list[tuple[int, int]]:
    """Matching quotes and brackets; those without a partner are ignored."""
    stack: list[tuple[str, int]] = []  # of the closing mark that is waited for, and the place of the opening one
    waiting: dict[str, int] = defaultdict(int)
    found: list[tuple[int, int]] = []
    for m in _PAIRED.finditer(block):
        c, at = m.group(), m.start()
        if waiting[c] and (c not in OPENERS or stack[-1][0] == c):
            while True:
                closer, opener = stack.pop()
                waiting[closer] -= 1
                if closer == c:
                    break
            found.append((opener, at))
        elif c in OPENERS or c == '"':
            stack.append((OPENERS.get(c, c), at))
            waiting[OPENERS.get(c, c)] += 1
    return found


@lru_cache(REMEMBERED)
def _shape(word: str) -> str:
    """What kind of word begins here."""
    core = word.lstrip("`¿¡")
    if not core:
        return "mark"
    c = core[0]
    if c in OPENERS or c == '"':
        return "quote" if c not in BRACKETS else "bracket"
    if c.isdigit():
        return "digit"
    if not c.isalpha():
        return "other"
    bare = core.rstrip(".,:;!?…。！？”“»\"')")
    if c.isascii() and (re.search(r"[a-z][A-Z0-9]|[._(]\w", bare) or core is not word):
        return "name"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    return "uncased"


@lru_cache(REMEMBERED)
def _known(word: str) -> str:
    """A word as a feature: lower case, digits alike, names and what is no word apart."""
    if re.search(r"[a-z][A-Z]|\.\w{2,}$", word):
        return "<name>"
    return re.sub(r"\d", "0", word.lower()) if len(word) <= LOOK else "<long>"


@lru_cache(REMEMBERED)
def _form(word: str) -> str:
    """The form of a word, whatever word it is: script, case and length."""
    if not word:
        return "none"
    if word.isdigit():
        return f"digits{min(len(word), 3)}"
    if _NUMBER.fullmatch(word):
        return "number"
    if re.fullmatch(r"(\w{1,2}\.)+\w{1,2}", word):
        return "initials"
    if re.search(r"[a-z][A-Z]|\d|[._]\w", word[:LOOK]):
        return "name"
    script = "marked" if _NO_MARKS.match(word) else "wide" if _WIDE.match(word) else "cased" if word[0].upper() != word[0].lower() else "uncased"
    case = "upper" if word.isupper() else "title" if word[:1].isupper() else "lower"
    return f"{script},{case},{min(len(word), 6)},{'vowel' if re.search('[aeiouyаеиоуыэюяαεηιουωáéíóúàèêäöü]', word.lower()) else 'none'}"


def _side(c: str) -> str:
    """What a character beside a blank is."""
    return "marked" if _NO_MARKS.match(c) else "digit" if c.isdigit() else "letter" if c.isalpha() else "other"


def _blank_features(left: str, right: str) -> tuple[list[str], int]:
    """Features of a blank between two runs of visible characters, without their marks."""
    bare = left.rstrip("!?.…")
    number = bool(re.fullmatch(r"[\d.,%:]+", bare))
    sides = f"{'number' if number else _side(bare[-1:] or '-')},{_side(right[:1])}"
    words = [re.sub(r"\d", "0", f) for f in (f"end={bare[-3:]}", f"after={right[:3].lower()}")]
    return [*words, "blank", f"sides={sides}", f"number={number},{bool(_NUMBER.fullmatch(right))}", f"number,next={number},{_side(right[:1])}", f"marked={bool(_NO_MARKS.search(bare))},{bool(_NO_MARKS.search(right[:LOOK]))}"], len(words)


def places(block: str, blanks: bool = False) -> list[Place]:
    """The open places of a block in order, with their features; all other characters are inside.

    Open are characters with an end mark and, beside letters of scripts without marks (with
    ``blanks`` everywhere), those before a blank.
    """
    opened = {b: a for a, b in _pairs(block)}
    marker = _ITEM.match(block)
    begin = marker.end() if marker else 0
    spots: list[tuple[int, int, str]] = []
    for m in _MARKS.finditer(block, begin):
        a, b = m.span()
        marks = m.group()
        if set(marks) <= {";", ";"}:
            if not _GREEK.search(block, spots[-1][1] if spots else begin, a):
                continue
        elif ";" in marks:
            continue
        end = _CLOSING.match(block, b).end()
        while end > b and block[end - 1] in "”“\"'’" and end - 1 not in opened and block[end - 1] != "’":
            end -= 1  # an opening quote, not a closing one
        after = block[end : end + 1]
        if after and not after.isspace():
            free = set(marks) & _STRONG or (not set(marks) & {"."} and (_WIDE.match(after) or _NO_MARKS.match(after)))
            if not free or after in ",，、:：;；)":
                continue
        spots.append((b, end, marks))
    runs: dict[int, tuple[str, str]] = {}
    if blanks or _NO_MARKS.search(block):
        ends = {end for _, end, _ in spots}
        left = None
        for m in _RUN.finditer(block, begin):
            if left and left.end() not in ends and (blanks or _NO_MARKS.search(left.group()) or _NO_MARKS.search(m.group())):
                spots.append((left.end(), left.end(), " "))
                runs[left.end()] = (left.group(), m.group())
            left = m
        spots.sort(key=lambda s: s[1])
    if not spots:
        return []
    begun, ended = sorted(a + 1 for a in opened.values()), sorted(opened)
    last = trimmed(block, 0, len(block))[1]
    tokens = [m.span() for m in _TOKEN.finditer(block, begin)]
    starts = [a for a, _ in tokens]
    return [_place(block, begin, begun, ended, opened, runs, tokens, starts, *spot) for spot in spots if spot[1] < last]


def _place(
    block: str, begin: int, begun: list[int], ended: list[int], opened: dict[int, int], runs: dict[int, tuple[str, str]],
    tokens: list[tuple[int, int]], starts: list[int], at: int, end: int, marks: str,
) -> Place:
    start = _VISIBLE.search(block, end).start()
    inside = bisect_right(begun, end - 1) > bisect_right(ended, end - 1)  # of more pairs begun than ended
    if marks == " ":
        features, words = _blank_features(*runs[end])
        return Place(end, start, features + [f"inside={inside}"], words)
    following = _RUN.match(block, start, start + LOOK).group()
    shape = _shape(following)
    kind = "dots" if marks in ("...", "…", "……", "..") else "stop" if set(marks) <= {"."} else "strong"
    mark_at = at - len(marks)
    k = bisect_left(starts, mark_at) - 1
    word, previous = "", ""
    if k >= 0:
        if tokens[k][1] >= mark_at:
            word, k = _LEAD.sub("", block[tokens[k][0] : mark_at]), k - 1
        if k >= 0 and len(word) <= LOOK:
            previous = block[tokens[k][0] : min(tokens[k][1], tokens[k][0] + LOOK)].rstrip(".")
    known, form = _known(word), _form(word)
    closed = [opened[k] for k in range(at, end) if k in opened]
    quote = context = ""
    if closed:
        first = min(closed)
        quote = "bracket" if block[first] in BRACKETS else "quote"
        lead = block[max(begin, first - LOOK) : first].rstrip()
        context = "colon" if lead[-1:] in (":", "：") else "begin" if not lead or _MARKS.match(lead[-1]) or lead[-1] in CLOSERS else "middle"
    spaced = "blank" if end < start else "none"
    letter = len(word) == 1 and word.isalpha()
    pair = letter and len(previous) == 1 and previous.isalpha()
    parted = letter and bool(re.match(r"\w{1,2}\.", following))
    base = f"{kind},{shape}" if not closed else f"{quote},{context},{shape},{spaced}"
    words = []
    if not closed and not inside:
        words += [f"word={known},{kind}", f"word,next={known},{shape},{kind}"]
        if word.isdigit():
            words.append(f"number={_known(previous)},{shape}")
        if pair:
            words += [f"pair={previous.lower()}.{known}", f"pair,next={previous.lower()}.{known},{shape}"]
    if shape in ("lower", "uncased"):
        words.append(re.sub(r"\d", "0", f"after={following[:3].lower()},{quote}"))
    features = [*words, "mark", f"marks={marks[:3]},{spaced}", f"base={base}", f"inside={inside},{kind}", f"letter={letter},{pair},{parted},{shape}", f"spaced={spaced},{kind}"]
    brief = "initial" if letter and word.isupper() else "initials" if form == "initials" and word[0].isupper() else "title" if len(word) <= 3 and word.istitle() else ""
    if brief and kind == "stop" and shape == "upper":
        features.append(f"brief={brief}")
    if not closed and not inside:
        features += [f"form={form},{kind}", f"form,next={form},{shape},{kind}"]
    if kind == "dots":
        features.append(f"dots={word == ''},{shape}")
    return Place(end, start, features, len(words))


def _near(one: Place, other: Place) -> int:
    """How far apart two places are, in four classes."""
    gap = other.end - one.end
    return 0 if gap <= 4 else 1 if gap <= 12 else 2 if gap <= 40 else 3


class Tagger:
    """A linear chain over the characters of a block, with the tags inside (0) and boundary (1).

    Characters that are no open place have no features and are inside, so the best path runs
    over them in one step from place to place; a move has a weight by its two tags and by how
    many characters lie between.
    """

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        #: Of a tag after a tag at a distance.
        self.moves: dict[tuple[int, int, int], float] = {}

    def decode(self, chain: list[list[str]], near: list[int], against: list[int] | None = None) -> list[int]:
        """The tags of greatest total score (Viterbi). A feature's weight speaks for boundary and against inside.

        ``near``: distance class of each two neighbours. ``against``: true tags that must win
        by ``MARGIN`` each, as in the fit.
        """
        if not chain:
            return []
        w, t = self.weights, self.moves
        scores = [sum([w.get(f, 0.0) for f in features]) for features in chain]
        if against is not None:
            scores = [s - MARGIN if truth else s + MARGIN for s, truth in zip(scores, against)]
        best = [-scores[0], scores[0]]
        back: list[tuple[int, int]] = []
        for s, d in zip(scores[1:], near):
            came, now = [], []
            for tag, own in ((0, -s), (1, s)):
                stay, turn = best[0] + t.get((0, tag, d), 0.0), best[1] + t.get((1, tag, d), 0.0)
                came.append(0 if stay >= turn else 1)
                now.append(max(stay, turn) + own)
            back.append((came[0], came[1]))
            best = now
        tags = [0 if best[0] >= best[1] else 1]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return tags[::-1]

    def tags(self, own: list[Place]) -> list[int]:
        return self.decode([p.features for p in own], [_near(x, y) for x, y in zip(own, own[1:])])

    def fit(self, chains: list[tuple[list[Place], list[int]]], start: dict[str, float], passes: int = PASSES, hidden: float = HIDDEN) -> Tagger:
        """Averaged structured perceptron with margin over chains with their true tags, from the weights ``start``."""
        total: dict[str, float] = defaultdict(float)
        moved: dict[tuple[int, int, int], float] = defaultdict(float)
        w: dict[str, float] = defaultdict(float, start)
        t: dict[tuple[int, int, int], float] = defaultdict(float)
        self.weights, self.moves = w, t
        step, draw = 0, random.Random(1)
        n = max(1, passes * len(chains))
        for _ in range(passes):
            for own, truth in chains:
                left = (n - step) / n
                step += 1
                blind = draw.random() < hidden
                chain = [p.features[p.words :] if blind else p.features for p in own]
                near = [_near(x, y) for x, y in zip(own, own[1:])]
                guess = self.decode(chain, near, truth)
                if guess == truth:
                    continue
                for features, was, should in zip(chain, guess, truth):
                    if was != should:
                        for f in features:
                            w[f] += should - was
                            total[f] += (should - was) * left
                for path, sign in ((truth, 1), (guess, -1)):
                    for move in zip(path, path[1:], near):
                        t[move] += sign * MOVE_STEP
                        moved[move] += sign * left * MOVE_STEP
        self.weights = {f: total.get(f, 0.0) + start.get(f, 0.0) for f in {*total, *start}}
        self.moves = dict(moved)
        return self


def layout_model(between: list[Place], within: list[Place], rounds: int = ROUNDS) -> dict[str, float]:
    """Log-odds weights of features for a place between two blocks against one within a block (logistic regression)."""
    seen = Counter(f for p in between + within for f in p.features)
    names = {f: k for k, f in enumerate(f for f, n in seen.items() if n >= SEEN)}
    at, row = [], []
    for n, p in enumerate(between + within):
        own = [names[f] for f in p.features if f in names]
        at += own
        row += [n] * len(own)
    at, row = np.array(at, int), np.array(row, int)
    n1, n0 = max(1, len(between)), max(1, len(within))
    truth = np.r_[np.ones(len(between)), np.zeros(len(within))]
    weight = np.r_[np.full(len(between), 0.5 / n1), np.full(len(within), 0.5 / n0)]
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[at], len(truth))
        g = np.bincount(at, ((1 / (1 + np.exp(-z)) - truth) * weight)[row], len(names)) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return dict(zip(names, w))


def _script(text: str) -> str:
    """The script of the first letter that is not plain Latin, if any."""
    m = _FOREIGN.search(text)
    return unicodedata.name(m.group(), "").split(" ")[0] if m else "LATIN"


def _stripped(block: str, ends: list[int]) -> tuple[str, list[int]]:
    """The block without end marks, and where its units end then."""
    out, cuts, start = [], [], 0
    for end in ends:
        piece = re.sub(r"[.!?…‥。！？।॥؟۔;]+(?=\W*\Z)", "", block[start:end]).strip()
        if piece:
            out.append(piece)
        start = end
    out.append(block[start:].strip())
    for piece in out[:-1]:
        cuts.append(len(piece) + (cuts[-1] + 1 if cuts else 0))
    return " ".join(out), cuts


def training_chains(texts: Iterable[str]) -> tuple[list[tuple[list[Place], list[int]]], dict[str, float]]:
    """Chains of places with tags, and the weights that the fit starts from, from texts whose only known boundaries are those of their layout.

    Each block is joined, without its list marker, to others of its script: the place at the
    joint is a boundary that the layout proves. How places within blocks look is known
    too, but not which of them are boundaries. Since boundaries look alike at joints and within
    blocks, a place whose looks are rarer at joints than within blocks, by far, is inside:
    abbreviations, decimals, ordinals and marks within quotes hardly ever stand at a joint.
    These labels, the joints, and the blocks with their end marks stripped and their units
    parted by blanks (for scripts without marks) are what the chain is fitted on, from the
    weights of that comparison.
    """
    between: list[Place] = []
    within: list[Place] = []
    bodies: list[str] = []
    joints: list[tuple[list[Place], int]] = []
    draw = random.Random(1)
    scripts: dict[str, list[str]] = defaultdict(list)
    for text in texts:
        for a, b in blocks(text):
            block = text[a:b].strip()
            marker = _ITEM.match(block)
            body = block[marker.end() :] if marker else block
            if body and not _HEADING.match(block):
                bodies.append(body)
                scripts[_script(body)].append(body)
    for one in bodies:
        mine = scripts[_script(one)]
        marked = bool(_NO_MARKS.search(one))
        for other in draw.choices(mine, k=JOINED):
            gap = draw.choice(("", " ")) if _WIDE.search(one[-3:]) or _WIDE.match(other) else " "
            left = draw.choice((one, one.rstrip("!?.…"))) if marked else one
            joined = places(left + gap + other)
            for p in joined:
                if p.end == len(left):
                    between.append(p)
                    joints.append((joined, p.end))
    inner = [places(b) for b in bodies]
    within = [p for own in inner for p in own]
    w = layout_model(between, within)
    score = lambda p: sum(w.get(f, 0.0) for f in p.features)
    usual = float(np.median([score(p) for p in between])) if between else 0.0
    least = usual + np.log(LIKE_BLOCKS)
    chains = []
    for body, own in zip(bodies, inner):
        tags = [int(score(p) >= least) for p in own]
        if own:
            chains.append((own, tags))
        if not _NO_MARKS.search(body) and not _WIDE.search(body) and len(body) <= 2000:
            bare, cuts = _stripped(body, [p.end for p, tag in zip(own, tags) if tag])
            blank = [p for p in places(bare, True) if p.features[p.words] == "blank"]
            chains.append((blank, [int(p.end in cuts) for p in blank]))
    for joined, end in joints:
        chains.append((joined, [int(p.end == end or score(p) >= least) for p in joined]))
    start = {f: START * x for f, x in w.items()}
    for f in ("mark", "blank"):
        start[f] = start.get(f, 0.0) - START * least
    return [c for c in chains if c[0]], {**start, **PRIOR}


def units(text: str | None, per_line: bool, tagger: Tagger) -> list[tuple[int, int]]:
    """Start and end of every unit of a text."""
    if not text:
        return []
    if per_line:
        return [s for a, b in lines(text) if (s := trimmed(text, a, b))]
    out = []
    for a, b in blocks(text):
        own = places(text[a:b])
        start = a
        for place, tag in zip(own, tagger.tags(own)):
            if tag:
                out.append(trimmed(text, start, a + place.end))
                start = a + place.end
        out.append(trimmed(text, start, b))
    return [s for s in out if s]


def fit_tagger(df: DataFrame, key: str, text: str, *, documents: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS) -> Tagger:
    """A tagger fitted on at most ``documents`` texts of at most ``chars`` characters, chosen by a hash of their key.

    A third of them is chosen among texts with letters of unpunctuated scripts.
    """
    usable = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where((F.length("text") > 0) & (F.length("text") <= chars))
    order = F.xxhash64("key", F.lit("sentences"))
    rare = F.col("text").rlike(f"[{UNPUNCTUATED}]")
    some = usable.where(~rare).orderBy(order, "key").limit(documents - documents // 3)
    others = usable.where(rare).orderBy(order, "key").limit(documents // 3)
    sample = some.unionByName(others).select("text").collect()
    return Tagger().fit(*training_chains(r.text for r in sample))


def sentences(df: DataFrame, key: str, text: str, *, per_line: str | None = None, tagger: Tagger | None = None) -> DataFrame:
    """``(key, start_pos, end_pos)``: the sentence units of every text, by code points, end exclusive.

    Empty lines, list items and headings bound blocks. Within a block, every character after
    which a unit could end (an end mark with its closing marks, or a blank beside letters of a
    script without end marks) is tagged as boundary or inside by a linear chain with Viterbi
    decoding; all other characters are inside. Units run from their first to their last
    visible character. ``per_line`` names a boolean column: true where each line is a unit.

    Null, empty and blank texts have no units. Repeated rows come out as often as they occur;
    a null key stays null. Texts of any length are tagged whole, each in one task, which holds
    one text at a time besides its batch. ``tagger`` is fitted on ``df`` if not given.
    """
    own = tagger or fit_tagger(df if per_line is None else df.where(~F.coalesce(F.col(per_line), F.lit(False))), key, text)
    flag = F.coalesce(F.col(per_line), F.lit(False)) if per_line else F.lit(False)
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"), flag.alias("per_line")).where("text is not null")
    weights, moves = own.weights, own.moves

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Tagger()
        mine.weights, mine.moves = weights, moves
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t, flat in zip(batch["key"], batch["text"], batch["per_line"]):
                for a, b in units(t, flat, mine):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=batch["key"].dtype), "start_pos": pd.Series(starts, dtype="int32"), "end_pos": pd.Series(ends, dtype="int32")})

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInPandas(run, f"key {kind}, start_pos int, end_pos int").withColumnRenamed("key", key)
