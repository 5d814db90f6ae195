r"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers. The random field is
trained on sentences made from the small labelled table below: emission weights on word-shape and context-word features, transition weights
between labels, over whole sentences. Words without digit, "@" or "+" can only have the label O; between two such words the best path splits, so
runs of other words are decoded with the transitions from and to the O on either side, those of one length together, by Viterbi in numpy.
Spans of the field are cut at line breaks and at words that touch pattern spans; what is left is added, with the kinds of the labels, if
it can be of its kind (`possible`: a card has a Luhn sum, for one).

Cases: null and empty texts have no spans; repeated rows each get a row; very long texts are read in time linear in
their length; an empty table gives no rows; other columns are kept by `redact` and ignored by `find`.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import table

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@+]")
_BREAK = re.compile(r"[\n\x0B\f\r]")
_ALNUM = re.compile(r"[A-Za-z0-9]+")

#: The labelled table: sentences with a place for a value, how values of each kind are written ("#": a digit, "^": a number up to 255, "~": a
#: word; the last digit of a card makes its Luhn sum right), and sentences with numbers that are none of these.
SENTENCES = {
    "phone": """
        call me on {} after six | my number is {} at work | tel {} or mail | phone {} please | reach us at {} now | or ring {} today
        fax {} is old | mobile {} works | you can call {} | Phone: {} | Tel: {} | contact us by phone at {} | his cell is {} and hers is not
        dial {} for help | text {} to join | the office ({}) is open | our hotline {} never sleeps | {} is my new number | whatsapp {}
        leave word for me on {} | toll free {} | telephone {} | telephone: {} | my phone number is {} | phone number: {} | cell phone {} | text her at {} | message me on {}
        the phone went, it was {} | a call from {} | tel. {} | reach them by phone on {} | call the office at {} | call or text {} | mobile: {} | fax: {} | her mobile is {} | my cell: {}
        call {} | ring {} | reach {} ~ | fax {} | dial {} | phone {} | tel {} | ~ ~ call {} ~ | ~: ring {} ~ | you can reach her on {} | fax ~ over to {} | ~ ~ ~ phone is {}
        ~ call {} ~ ~ | ~ ring {} | mobile number {} | cell number {} | leave a message on {} | {} | {} | {}
    """,
    "card": """
        card {} was charged | paid with {} yesterday | visa {} expired | the card {} is mine | credit card number {} please | my mastercard is {}
        the credit card no. {} | card no {} | credit card: {} | by debit card {} | mastercard {} | visa card {} | took my credit card {} | use my visa {} ~ | ~ card {} ~ | charge it to {} today | Card: {} | the payment from {} failed | debit card {} was lost | amex {} | card no. {} ends soon
    """,
    "email": """
        write to {} soon | mail {} for help | send it to {} please | contact {} today | email {} | e-mail: {} | reply to {} by friday
        her address is {} | cc {} on this | questions go to {} | From: {} | {} wrote
    """,
    "ip": """
        host {} is down | server {} answers | from {} came the call | ping {} first | the address {} is banned | connect to {} | client {} left
        listening on {} | ip {} | gateway {} drops packets | ~ {} ~ | {} | ~ from {} ~ ~ | server at {} ~ | ~ at {} ~ | the hosts {} and more
    """,
}
VALUES = {
    "phone": """
        (###) ###-#### | ###-###-#### | (0##) #### #### | ###.###.#### | 0### ### #### | +## ## #### #### | +1 (###) ###-#### | +## ### #### ####
        0## #### #### | ### ### #### | 0#### ###### | 0# ## ## ## ## | 1-###-###-#### | (###)###-#### | +##-##-####### | 0###-#######
    """,
    "card": "####.####.####.#### | #### #### #### #### | ####-####-####-#### | ################ | ############### | #### ###### ##### | ####/####/####/####",
    "email": "~@localhost | ~.~@intranet | ~+~@~.org | ~_##@mail.~.com | ~@~ | ~##@~.net | ~@mail-## | ~@~# | ~.~@~-# | ~-~@~## | ~.~.~@~",
    "ip": "^.^.^.^ | ^.^.^.^:#### | ^.^.^.^/## | ^.^.^.^",
}
NONE = """
    version #.#. of the license | licensed under version #.#. here | in 19## there were ## of #### items | it costs ##.## or #,###.## in all
    at ##:## on 20##-##-## we met | chapter #. begins on page ### | password=##f#ede#e#e# is set | key "######a#deafebc#ca####" was lost
    token AKIAW##HKU#VBL# leaked | order ################ has shipped | the number ################ is random | room ##-## and row #-# of 20##
    isbn 978-#-##-######-# is a book | a score of #-# in 20## + # more | c++ and a+b or #+# are sums | no. # of ## ranked 1st and 2nd
    release #.#.# build #### of 20## | user @home and @work are tags | the years 19##-19## and 20##/## | from 1### to 1### at war
    ##% of ###,### votes | pages ##-##, ###-### and ### | section #.#.#.# says so | build ########## passed | id ############ is taken
    sold ## ## and ## of them | item #####-#### of lot ### | $#,###,### in 20## | the ratio #.#### is near ##.# | timestamp ########## was read
    v #.#.##-beta of ##.##.20## | invoice 20##-###### is due | serial ###-###-###-### is void | a ##-year-old with ### ## coins
    call # of ## failed | phone model #### costs ### | card # of ## is red | mail ### letters | ring # times | server ## of ## answers
    is ################ there | of the ################ and | ################ then | to ################ by ## | row ################ ################ end
    checksum ######################## is ok | ######################## | the digits ######################################## of pi
    tel aviv had ###,### people in 19## | fax machines of 19## | the cell has ## walls | visa rules of 20## | text ## lines | dial # twice
"""
#: Sentences with a place for a number that is nobody's, and how such numbers are written ("@": a capital letter); numbers written like phones and cards
#: are among them, so it is the words around a number that tell.
PLAIN_SENTENCES = """
    part number {} fits ~ | population {} people | sku {} in stock | a total of {} EUR | the ~ of {} ~ | ~ ~ {} ~ | {} ~ ~ | lat {} lon {} | item {} ~ | article {}
    serial {} ~ | code {} | points {} | reference {} | from {} to {} | in {} ~ | no. {} ~ | nr {} | id {} | file {} ~ | model {} ~ | key {} | plate {} | lot {}
    ~: {} | ~ {} and {} | iban {} | account {} at the bank | isbn {} | ean {} | barcode {} ~ | order {} | invoice {} ~ | about {} ~ | over {} ~ | {} units
    {} km | {} dollars | costs {} | sold {} copies | the digits {} | results {} {} {} | ~, {}, ~ | between {} and {} ~ | the number {} is ~
    the visa rules of {} | a phone of {} | phones: {} sold | the card game of {} | mail of {} | a call for {} ~ | call number {} ~ | fax machines {} | text of {} words | address {} ~ street
    the server has {} ~ | hosts {} guests | a test of {} ~ | ratio {} | section {} | page {} | room {} | release {} | version {} | tracking {} | ticket {} | coupon {}
"""
PLAIN_NUMBERS = """
    # ### ### | ## ### ### | ### ### ### | # ### ### ### | ## ### ### ### | ### ### | # ### | ## ### | ### ### ### ### | ## ## ## | ## ## ## ## | # # # # # | ## ## | ### ### ####
    #### #### | #### #### # | #### #### #### # | #### #### #### #### | ####-####-#### | ##-##-## | ###-###-### | ###-###-#### | ##-###-## | ####-##-## | ##-##-#### | #### ### ###
    #### #### #### | ### # ## ###### # | ###-#-##-######-# | @@## #### #### #### #### ## | @@## @@@@ #### #### #### ## | ##.#### ##.#### | ## ### ### # ### ### | #.#.#.#### | ##.#.#-# | ######
    ##### ##### | ######## | ########## | ############ | ################ | ##@### | @@-#### | #:##.### | #-# #-# #-# | ##-## ##-## ##-## | ####-#### | #### #### #### #### ## | ###.###.### | # ## # | 0# ## ## ##
    0### #### | 0## ### #### | 0#-#### #### | ####.####.####.#### | ####/####/#### | #,###,### | ##,#%  | #.## #.## | 20##-####-### | -#.## -#.## | ### ### ###-## | ## ## # @ | @# ### ### @#
"""
#: What may follow a value, sentences made of each row of the table, and the seed of their digits and words.
ENDS, MADE, TABLE_SEED = ("", "", "", ".", ",", "!", "?", ";", ":"), 8, 8
#: Each plain sentence is made with every so many-th number form, and words so far before and behind a run are features.
PLAIN_STEP, BEFORE, BEHIND = 4, 6, 3
#: Forms of random groups for each plain sentence, the first so many phone forms that stand alone, and digits of phones and cards in random groups.
PLAIN_GROUPED, BARE, GROUPED = 6, 3, {"phone": (7, 12), "card": (13, 16)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each "@" outwards, so that no run of letters is read twice."""
    after, at = 0, text.find("@")
    while at >= 0:
        left = text[max(after, at - 4096) : at]
        run = len(left) - len(left.rstrip(LOCAL))
        if run == 4096:
            left = text[after:at]
            run = len(left) - len(left.rstrip(LOCAL))
        if run and (m := _DOMAIN.match(text, at + 1)):
            yield at - run, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted; the kinds are those of KINDS."""
    if not _MARK.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def shape(word: str) -> str:
    """Letters and digits by class, runs kept up to four."""
    s = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", s)


_OPENING, _CLOSING = "[{<\"'#*%&$!|,;:", ".,;:!?]}>\"'*|"


def core(word: str) -> str:
    """The word without signs around it; brackets around digits stay."""
    w = word.lstrip(_OPENING).rstrip(_CLOSING)
    while w.endswith(")") and w.count(")") > w.count("("):
        w = w[:-1].rstrip(_CLOSING)
    return w[1:] if w.startswith("(") and ")" not in w else w


def features(words: list[str], a: int, b: int) -> list[list[str]]:
    """Word-shape features of words[a:b], a run of words with a mark, and the words around it."""
    cores = [core(w) for w in words[a:b]]
    shapes = [shape(c) for c in cores]
    plain = lambda i: re.sub(r"[^a-z]+", "", words[i].lower()) if 0 <= i < len(words) else "^"
    around = ["w=" + plain(a - 1), "v=" + plain(a - 2) + "_" + plain(a - 1), "z=" + plain(b)]
    around += sorted({"near=" + w for i in (*range(a - BEFORE, a), *range(b, b + BEHIND)) if (w := plain(i)) not in ("", "^")})
    total = sum(c.isdigit() for w in cores for c in w)
    out = []
    for i, (w, s) in enumerate(zip(cores, shapes)):
        digits = "".join(c for c in w if "0" <= c <= "9")
        short = re.sub(r"(.)\1+", r"\1", s)
        before, after = shapes[i - 1] if i else "-", shapes[i + 1] if i + 1 < len(shapes) else "-"
        found = ["bias", f"s={s}", f"c={short}", f"n={min(len(digits), 20)}", f"t={min(total, 24)}", f"p={before}", f"q={after}", f"f={s[:1]}", f"ps={before}|{s}", f"sq={s}|{after}", f"len={min(len(cores), 6)}|{s}"]
        found += [f"{x}|{short}" for x in around[:3]] + around
        if 12 <= len(digits) <= 19:
            found.append(f"luhn={luhn(digits)}")
        if "@" in w[1:]:
            found.append("at-inside")
        parts = re.split(r"[:/]", w)[0].split(".")
        if len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts):
            found.append("octets")
        out.append(found)
    return out


def _runs(words: list[str]) -> list[tuple[int, int]]:
    """Maximal runs of words with a mark."""
    marked = [bool(_MARK.search(w)) for w in words]
    runs, i = [], 0
    while i < len(words):
        if marked[i]:
            j = i
            while j < len(words) and marked[j]:
                j += 1
            runs.append((i, j))
            i = j
        i += 1
    return runs


def _rows(table: str) -> list[str]:
    return [x.strip() for line in table.strip().splitlines() for x in line.split("|") if x.strip()]


def _written(form: str, rng: random.Random, card: bool = False) -> str:
    """A form with its signs replaced."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 9)))
    one = {"#": lambda: rng.choice("0123456789"), "^": lambda: str(rng.randint(0, 255)), "~": word}
    out = re.sub(r"[#^~]", lambda m: one[m.group()](), form)
    return next(x for x in (out[:-1] + d for d in "0123456789") if luhn(re.sub(r"\D", "", x))) if card else out


def _grouped(rng: random.Random, least: int, most: int) -> str:
    """A form of `least` to `most` digits in groups, as numbers of every kind may be written."""
    left, groups = rng.randint(least, most), []
    while left:
        size = left if left <= 4 else rng.choice([n for n in (2, 3, 3, 4, 4, 5) if left - n > 1])
        groups.append("#" * size)
        left -= size
    first = rng.choice(["", "", "0"])
    if first and len(groups) > 1:
        groups[0] = first + groups[0][1:]
    mark = rng.choice([" ", " ", "-", "-", ".", "/"])
    if rng.random() < 0.15:
        return groups[0] + rng.choice([" ", "-"]) + mark.join(groups[1:]) if len(groups) > 1 else groups[0]
    return mark.join(groups)


def plain_sentences(rng: random.Random) -> Iterator[str]:
    """Every plain sentence with every PLAIN_STEP-th number form."""
    forms = _rows(PLAIN_NUMBERS)
    capital = lambda m: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for i, sentence in enumerate(_rows(PLAIN_SENTENCES)):
        for form in forms[i % PLAIN_STEP :: PLAIN_STEP]:
            yield _written(sentence.replace("{}", re.sub("@", capital, form)), rng)
        for _ in range(PLAIN_GROUPED):
            yield _written(sentence.replace("{}", _grouped(rng, 6, 16)), rng)


def labelled_table(sentences: dict[str, str] = SENTENCES, values: dict[str, str] = VALUES, none: str = NONE, made: int = MADE, seed: int = TABLE_SEED, plain: bool = False) -> list[tuple[list[str], list[int]]]:
    """(words, labels) of the sentences made from a table; label 0 is O, then KINDS."""
    rng, out = random.Random(seed), []
    for kind in sentences:
        forms = _rows(values[kind])
        for i, sentence in enumerate(_rows(sentences[kind]) * made):
            form = forms[i % len(forms)]
            if sentence == "{}":
                form = forms[i % BARE]  # without words around it
            elif plain and kind in GROUPED and i % 2:
                form = _grouped(rng, *GROUPED[kind])
            sentence = _written(sentence, rng)
            value = _written(form, rng, kind == "card")
            words = sentence.replace("{}", "{} ").replace("} )", "})").split()
            at = next(k for k, w in enumerate(words) if "{}" in w)
            inside = (words[at].replace("{}", value) + (rng.choice(ENDS) if words[at].endswith("}") else "")).split()
            out.append(([*words[:at], *inside, *words[at + 1 :]], [0] * at + [KINDS.index(kind) + 1] * len(inside) + [0] * (len(words) - at - 1)))
    for sentence in _rows(none) * made:
        words = _written(sentence, rng).split()
        words[-1] += rng.choice(ENDS)
        out.append((words, [0] * len(words)))
    for words in (x.split() for x in (plain_sentences(rng) if plain else ())):
        words[-1] += rng.choice(ENDS)
        out.append((words, [0] * len(words)))
    return out


class ConditionalRandomField:
    """Emission weights by feature and transition weights, trained by gradient ascent on the log-likelihood."""

    def __init__(self, labels: int = len(KINDS) + 1, l2: float = 0.05, steps: int = 120, rate: float = 0.1):
        self.n, self.l2, self.steps, self.rate = labels, l2, steps, rate
        self.index: dict[str, int] = {}

    def fit(self, rows: list[tuple[list[str], list[int]]]) -> ConditionalRandomField:
        by_length = defaultdict(list)
        for words, labels in rows:
            for a, b in _runs(words):
                by_length[b - a].append(([[self.index.setdefault(f, len(self.index)) for f in x] for x in features(words, a, b)], labels[a:b]))
        groups = []
        for n, seqs in by_length.items():
            ids = [x for s, _ in seqs for x in s]
            counts = np.array([len(x) for x in ids])
            hot = np.eye(self.n)[np.array([y for _, y in seqs])]
            groups.append((np.concatenate([np.array(x) for x in ids]), counts, np.cumsum(counts) - counts, hot, n))
        self.emit, self.move = np.zeros((len(self.index), self.n)), np.zeros((self.n, self.n))
        state = [np.zeros_like(p) for p in (self.emit, self.emit, self.move, self.move)]
        for step in range(1, self.steps + 1):
            ge, gm = -self.l2 * self.emit, -self.l2 * self.move
            for group in groups:
                self._gradient(*group, ge, gm)
            for p, g, m, v in ((self.emit, ge, state[0], state[1]), (self.move, gm, state[2], state[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradient(self, flat, counts, starts, hot, n, ge, gm) -> None:
        """Observed minus expected features and transitions of all runs of length n, by the forward-backward recursions."""
        e = np.add.reduceat(self.emit[flat], starts).reshape(-1, n, self.n)
        alpha, beta = [e[:, 0] + self.move[0]], [np.broadcast_to(self.move[:, 0], e[:, 0].shape)]
        for t in range(1, n):
            alpha.append(e[:, t] + np.logaddexp.reduce(alpha[-1][:, :, None] + self.move, axis=1))
            beta.append(np.logaddexp.reduce(self.move + (e[:, n - t] + beta[-1])[:, None, :], axis=2))
        beta.reverse()
        z = np.logaddexp.reduce(alpha[-1] + beta[-1], axis=1)
        left = hot - np.exp(np.stack(alpha, 1) + np.stack(beta, 1) - z[:, None, None])
        np.add.at(ge, flat, np.repeat(left.reshape(-1, self.n), counts, axis=0))
        gm[0] += left[:, 0].sum(0)
        gm[:, 0] += left[:, -1].sum(0)
        for t in range(1, n):
            pair = alpha[t - 1][:, :, None] + self.move + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]
            gm += np.einsum("bi,bj->ij", hot[:, t - 1], hot[:, t]) - np.exp(pair).sum(0)

    def emissions(self, words: list[str], a: int, b: int) -> np.ndarray:
        """Scores of the labels of words[a:b], a run."""
        out = np.zeros((b - a, self.n))
        for row, found in zip(out, features(words, a, b)):
            for f in found:
                if (j := self.index.get(f)) is not None:
                    row += self.emit[j]
        return out

    def viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run (length x labels) between words labelled O; runs of one length are decoded together."""
        out: list = [None] * len(runs)
        lengths = np.array([len(r) for r in runs])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            e = np.stack([runs[i] for i in at])
            score, back = e[:, 0] + self.move[0], []
            for t in range(1, n):
                all_moves = score[:, :, None] + self.move[None]
                back.append(all_moves.argmax(1))
                score = all_moves.max(1) + e[:, t]
            best = [(score + self.move[:, 0]).argmax(1)]
            for b in reversed(back):
                best.append(b[np.arange(len(at)), best[-1]])
            for i, labels in zip(at, np.stack(best[::-1], axis=1)):
                out[i] = labels
        return out


@lru_cache(maxsize=1)
def train() -> ConditionalRandomField:
    return ConditionalRandomField().fit(labelled_table(plain=True))


def possible(kind: int, span: str) -> bool:
    """Whether a span of the field can be of its kind: digits that a card, an address or a number to call have, something before and behind an "@"."""
    digits = re.sub(r"[^0-9]", "", span)
    if KINDS[kind] in ("card", "phone") and re.search(r"[^\W\d_]", span):
        return False
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind] == "phone":
        return 7 <= len(digits) <= 15
    return 0 < span.find("@") < len(span) - 1 if KINDS[kind] == "email" else bool(digits)


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: ConditionalRandomField) -> list[list[tuple[int, int, int]]]:
    """Spans of the field, without the words that touch pattern spans and in one line each, for a batch of texts."""
    runs, places = [], []
    for k, text in enumerate(texts):
        if not _MARK.search(text):
            continue
        found = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in found]
        for a, b in _runs(words):
            runs.append(model.emissions(words, a, b))
            places.append((k, found[a:b]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known = [(np.array([s[0] for s in sorted(b)]), np.maximum.accumulate([s[2] for s in sorted(b)])) if b else None for b in bases]
    for (k, where), labels in zip(places, model.viterbi(runs)):
        if known[k] and labels.any():
            starts, ends = known[k]
            labels = [0 if (n := int(np.searchsorted(starts, b))) and ends[n - 1] > a else y for (a, b), y in zip(where, labels)]
        i = 0
        while i < len(labels):
            j = i + 1
            while j < len(labels) and labels[j] == labels[i] and not (labels[i] and _BREAK.search(texts[k], where[j - 1][1], where[j][0])):
                j += 1
            if labels[i]:
                span = texts[k][where[i][0] : where[j - 1][1]]
                a = where[i][0] + len(span) - len(span.lstrip(_OPENING))
                b = where[i][0] + max((m.end() for m in _ALNUM.finditer(span)), default=0)
                a += texts[k][a:b].startswith("(") and ")" not in texts[k][a:b]
                if a < b and possible(int(labels[i]) - 1, texts[k][a:b]):
                    out[k].append((a, int(labels[i]) - 1, b))
            i = j
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: ConditionalRandomField | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans) of every row."""
    model = model or train()

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [x or "" for x in part["text"]]
            bases = [base_spans(x) for x in texts]
            more = added_spans(texts, bases, model)
            counts = {f"n_{kind}": [sum(s[1] == i for s in b) for b in bases] for i, kind in enumerate(KINDS)}
            yield pd.DataFrame({"id": part["id"], **counts, "base_spans": [joined(b) for b in bases], "spans": [joined(b + m) for b, m in zip(bases, more)]})

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(batch, schema)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans the first goes on to the furthest end."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", model: ConditionalRandomField | None = None) -> DataFrame:
    """`docs` with the personal data of the text replaced by <kind>; null texts stay null."""
    model = model or train()

    def batch(texts: pd.Series) -> pd.Series:
        known = [x or "" for x in texts]
        bases = [base_spans(x) for x in known]
        more = added_spans(known, bases, model)
        return pd.Series([None if x is None else redact_text(x, b + m) if b or m else x for x, b, m in zip(texts, bases, more)], dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(batch, "string")(F.col(text_col)))



def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
