"""Personal data by weak supervision.

Candidate spans come from strict patterns, whose valid matches always stand, and from looser ones in
English, German, French and Spanish. Five labelers (validity, context words, context against,
gazetteer, shape) vote for, against or not at all on each candidate. Expectation-maximisation over
the counts of vote patterns estimates every labeler's reliability for each kind, drawn towards that
over all kinds, and the probability of each pattern. A logistic span classifier is trained on those
probabilities; it sees characters and shape of the span and the words around it besides the votes,
and it alone decides on the loose candidates.

The driver gets counts by vote pattern, at most kinds x 3^5, and for the classifier at most
``train_rows`` candidates a kind, those of the smallest hash. Gazetteers are a table (list, entry) of
at most ``MAX_ENTRIES`` rows, which is checked before it is sent to the tasks.

Defined cases: null and empty texts have no spans. Repeated rows are each returned. Without any
loose candidate nothing is added. Ties of spans go by kind. Patterns take linear time in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("ssn", "iban", "local_phone", "masked_email", "person", "address", "birthdate", "account")
LABELERS = ("valid", "context", "against", "gazetteer", "shape")

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits can only match from its start, so the look-behind keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.(/-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z-])")
MASKED_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{1,63})+")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Sr", "Sra", "Señor", "Señora")
#: A name follows these words; they are no part of the span.
NAMED_BY = ("name is", "name:", "Name ist", "heiße", "Name:", "appelle", "nom est", "nom :", "llamo", "nombre es", "nombre:")
WORD = r"[A-ZÀ-Þ][a-zß-ÿ]+"
PERSON = re.compile(rf"\b(?:{'|'.join(TITLES)})\.?\x20{WORD}(?:[\x20-]{WORD})?|(?:{'|'.join(f'(?<={n}\x20)' for n in NAMED_BY)}){WORD}(?:[\x20-]{WORD})?")
STREET = r"(?:Street|Road|Avenue|Lane|Drive|Boulevard)"
ADDRESS = re.compile(
    rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20(?:{WORD}\x20){{1,3}}{STREET}\b"
    rf"|\b(?:[A-ZÀ-Þ][a-zß-ÿ]*(?:straße|strasse|weg|platz|gasse))\x20[0-9]{{1,4}}[a-z]?\b"
    rf"|(?<![0-9A-Za-z])[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place)\x20(?:(?:de|du|des|la|le)\x20)*{WORD}"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo)\x20(?:(?:de|del|la|los)\x20)*{WORD},?\x20[0-9]{{1,4}}\b"
)
STREET_WORDS = ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "straße", "strasse", "weg ", "platz ", "gasse ", " rue ", " avenue ", " boulevard ", " place ", "Calle ", "Avenida ", "Plaza ", "Paseo ")
PERSON_WORDS = tuple(t + end for t in TITLES for end in (" ", ". ")) + tuple(n + " " for n in NAMED_BY)
BIRTHDATE = re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?![0-9A-Za-z/-])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{8,19}(?![0-9A-Za-z-])")

#: The default gazetteers; ``load_gazetteers`` takes others from a table.
GAZETTEERS = {
    "first_name": frozenset(
        "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen "
        "daniel lisa matthew nancy anthony betty mark sandra paul ashley andrew emily joshua anna kevin laura brian maria george peter hans klaus jürgen "
        "sophie pierre jean marie jacques claire louis juan jose carlos luis ana carmen lucia pedro miguel sofia martin stefan petra ursula helga".split()
    ),
    "top_domain": frozenset("com org net edu gov mil info io co uk de fr es it nl eu us ca au ch at be se no fi dk pl pt br mx ar jp cn in ru".split()),
    "calling_code": frozenset("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 81 82 86 90 91 351 353 358 420".split()),
}
MAX_ENTRIES = 1_000_000
PHONE_WORDS = ("phone", "tel", "call", "mobile", "fax", "mobil", "anruf", "appel", "portable", "móvil", "llam", "rufen")
MAIL_WORDS = ("mail", "contact", "correo", "write to", "kontakt", "écri", "schreib")
CONTEXT = {
    "email": MAIL_WORDS,
    "ip": ("ip", "host", "server", "address", "addr", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "carte", "tarjeta", "karte"),
    "phone": PHONE_WORDS,
    "ssn": ("ssn", "social security"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "local_phone": PHONE_WORDS,
    "masked_email": MAIL_WORDS,
    "person": ("name", "patient", "contact", "signed", "dear", "geehrte", "heiße", "nom", "appelle", "nombre", "llamo", "estimad", "cher"),
    "address": ("live", "address", "adresse", "wohn", "habite", "vivo", "dirección", "domicil", "lives"),
    "birthdate": ("born", "birth", "dob", "gebor", "geburt", "né ", "née ", "naissance", "nacid", "nacimiento"),
    "account": ("account", "konto", "compte", "cuenta", "customer", "kunden", "client", "cliente", "passport", "reisepass", "passeport", "pasaporte"),
}
AGAINST = ("version", "isbn", "issn", "doi", "page", "section", "order no", "part no", "invoice", "seite", "abschnitt", "rechnung", "facture", "página", "factura", "score", "model", "ticket")


def load_gazetteers(table: DataFrame) -> dict[str, frozenset[str]]:
    """Gazetteers from a table (list, entry); a table above ``MAX_ENTRIES`` rows is an error."""
    rows = table.select("list", "entry").where("list is not null and entry is not null").distinct()
    n = rows.count()
    if n > MAX_ENTRIES:
        raise ValueError(f"{n} gazetteer entries; at most {MAX_ENTRIES} are sent to the tasks")
    found: dict[str, set[str]] = {k: set() for k in GAZETTEERS}
    for r in rows.collect():
        found.setdefault(r["list"], set()).add(r["entry"])
    return {k: frozenset(v) for k, v in found.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` ends the run of local-part characters that starts a match, after the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(LOCAL_PART))
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", end)


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns' valid matches; failing matches are not tried again."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _ip_ok(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def loose_spans(text: str, has_digits: bool) -> list[tuple[int, int, int]]:
    found = []
    patterns = [(SSN, 4), (IBAN, 5), (LOCAL_PHONE, 6), (BIRTHDATE, 10), (ACCOUNT, 11)] if has_digits else []
    if has_digits and any(w in text for w in STREET_WORDS):
        patterns.append((ADDRESS, 9))
    low = text.casefold() if "[" in text or "(" in text else ""
    if "at]" in low or "at)" in low:
        patterns.append((MASKED_EMAIL, 7))
    if any(w in text for w in PERSON_WORDS):
        patterns.append((PERSON, 8))
    for pattern, kind in patterns:
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return found


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _date_ok(s: str) -> bool:
    parts = [int(p) for p in re.split("[./-]", s)]
    year, rest = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
    return 1900 <= year <= 2030 and min(rest) >= 1 and max(rest) <= 31 and min(rest) <= 12


def _valid(kind: str, s: str) -> int:
    if kind == "ssn":
        return int(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    if kind == "iban":
        return int(_iban_ok(s))
    if kind == "local_phone":
        return int(7 <= len(_digits(s)) <= 12 and len(set(_digits(s))) > 2 and not BIRTHDATE.fullmatch(s))
    if kind == "birthdate":
        return int(_date_ok(s))
    return 1 if kind in BASE_KINDS else -1


def _gazetteer(kind: str, s: str, lists: dict[str, frozenset[str]]) -> int:
    if kind in ("email", "masked_email"):
        return 1 if re.split(r"[^A-Za-z]", s)[-1].lower() in lists["top_domain"] or s.rstrip(")] ")[-3:].lower() in lists["top_domain"] else -1
    if kind == "phone":
        return 1 if any(_digits(s)[:n] in lists["calling_code"] for n in (1, 2, 3)) else 0
    if kind == "card":
        return 1 if s[0] in "3456" else -1
    if kind == "person":
        return 1 if any(w.lower() in lists["first_name"] for w in re.split("[ .-]+", s)) else -1
    return -1


def votes(text: str, start: int, kind: int, end: int, lists: dict[str, frozenset[str]]) -> tuple[int, ...]:
    """1 for, 0 against, -1 none, by LABELERS."""
    name, s = KINDS[kind], text[start:end]
    before = text[max(0, start - 40) : start].casefold()
    digits, words = _digits(s), s.split()
    plain = len(set(digits)) <= 1 and len(digits) > 3 or digits[:9] in ("123456789", "012345678") or len(words) > 1 and len(set(words)) == 1
    context = any(w in before for w in CONTEXT[name])
    return (
        _valid(name, s),
        1 if context else 0 if name in ("account", "birthdate", "local_phone") else -1,
        0 if any(w in before[-20:] for w in AGAINST) else -1,
        _gazetteer(name, s, lists),
        0 if plain else (1 if len(digits) > 8 and name not in ("account", "local_phone") else -1),
    )


FEATURES = 1024
#: Log odds from which the classifier takes a span: a probability of 0.6.
TAKEN = 0.405


def features(text: str, start: int, kind: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Hashed features: kind and votes, the span's shape and its runs of three characters, and the words around it."""
    s = text[start:end]
    shape = re.sub("[0-9]", "9", re.sub("[a-zß-ÿ]", "a", re.sub("[A-ZÀ-Þ]", "A", s)))[:24]
    around = [f"b{w}" for w in re.findall(r"\w+", text[max(0, start - 40) : start].casefold())[-4:]] + [f"a{w}" for w in re.findall(r"\w+", text[end : end + 30].casefold())[:2]]
    names = [f"k{kind}", f"s{shape}", f"n{len(s) // 4}", *[f"v{kind}{i}{v}" for i, v in enumerate(vote)], *[f"c{shape[i : i + 3]}" for i in range(len(shape) - 2)], *around]
    return sorted({1 + xxhash.xxh32_intdigest(n) % (FEATURES - 1) for n in names} | {0})


def candidate_key(kind: int, vote: tuple[int, ...]) -> str:
    """Kind and votes: what expectation-maximisation counts."""
    return f"{kind}:" + "".join("n01"[x + 1] for x in vote)


def spans_of(text: str | None, lists: dict[str, frozenset[str]] = GAZETTEERS) -> list[tuple[int, int, int, str, list[int]]]:
    """(start, kind, end, key, features) of all candidates; loose ones that touch a strict one are left out."""
    if not text:
        return []
    has_digits = re.search("[0-9]", text) is not None
    base = base_spans(text) if has_digits or "@" in text else []
    loose = loose_spans(text, has_digits)
    if base and loose:
        ends = np.array([b[2] for b in base])
        reach = np.maximum.accumulate(ends)
        starts = np.array([b[0] for b in base])
        loose = [c for c in loose if (i := int(np.searchsorted(starts, c[2]))) == 0 or reach[i - 1] <= c[0]]
    out = []
    for a, k, b in sorted(base + loose):
        vote = votes(text, a, k, b, lists)
        out.append((a, k, b, candidate_key(k, vote), [] if k < len(BASE_KINDS) else features(text, a, k, b, vote)))
    return out


CANDIDATES = "array<struct<start:int,kind:int,end:int,key:string,features:array<int>>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: dict[str, frozenset[str]] = GAZETTEERS) -> DataFrame:
    """(id, cands) a row of ``docs``."""
    names = ("start", "kind", "end", "key", "features")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "cands": pd.Series([[dict(zip(names, c, strict=True)) for c in spans_of(t, lists)] for t in b["_text"]], dtype=object)})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, cands {CANDIDATES}").withColumnRenamed("_id", id_col)


@dataclass(frozen=True)
class SpanModel:
    """``weights`` of the classifier by feature; ``reliability``: by kind and labeler, the estimated
    probability that a vote is right; ``lists``: the gazetteers that the votes used."""

    weights: np.ndarray
    reliability: dict[str, dict[str, float]]
    lists: dict[str, frozenset[str]]

    def takes(self, kind: int, found: list[int]) -> bool:
        return kind < len(BASE_KINDS) or float(self.weights[found].sum()) >= TAKEN


def _em(vote: np.ndarray, n: np.ndarray, towards: np.ndarray | None = None, weight: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, P(vote for | class) by labeler, prior. Starts at the majority.

    ``towards``: P(vote for | class) that counts as ``weight`` votes of each class. No labeler may be worse
    than chance, without which the two classes could change places.
    """
    cast, yes = vote >= 0, vote == 1
    post = np.clip((yes.sum(1) + 0.5) / (cast.sum(1) + 1.0), 0.05, 0.95)
    aim = np.array([[0.7] * vote.shape[1], [0.3] * vote.shape[1]]) if towards is None else towards
    for _ in range(rounds):
        pos, neg = n * post, n * (1 - post)
        prior = float(np.clip((pos.sum() + 1) / (n.sum() + 2), 0.02, 0.98))
        p1 = np.clip(((pos[:, None] * yes).sum(0) + weight * aim[0]) / ((pos[:, None] * cast).sum(0) + weight), 0.5, 0.99)
        p0 = np.clip(((neg[:, None] * yes).sum(0) + weight * aim[1]) / ((neg[:, None] * cast).sum(0) + weight), 0.01, 0.5)
        like = np.log(prior / (1 - prior)) + (cast * np.where(yes, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)))).sum(1)
        post = 1 / (1 + np.exp(-like))
    return post, np.stack([p1, p0]), prior


def label_model(counts: dict[str, int]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Probability of each key, and reliabilities by kind: over all kinds first, which then draw each kind's own."""
    keys = sorted(counts)
    if not keys:
        return {}, {}
    kind = np.array([int(k.split(":")[0]) for k in keys])
    n = np.array([counts[k] for k in keys], float)
    vote = np.array([["n01".index(c) - 1 for c in k.split(":")[1]] for k in keys])
    _, pooled, _ = _em(vote, n)
    found, right = {}, {}
    for k in sorted(set(kind.tolist())):
        mine = kind == k
        post, by_class, prior = _em(vote[mine], n[mine], pooled)
        found |= dict(zip([x for x, m in zip(keys, mine, strict=True) if m], post.tolist(), strict=True))
        right[KINDS[k]] = dict(zip(LABELERS, (prior * by_class[0] + (1 - prior) * (1 - by_class[1])).round(4).tolist(), strict=True))
    return found, right


def fit(counts: dict[str, int], sample: list[tuple[str, list[int]]], lists: dict[str, frozenset[str]] = GAZETTEERS, rounds: int = 200, ridge: float = 0.01) -> SpanModel:
    """The label model over all ``counts``, then the logistic classifier on the soft labels of ``sample`` (key, features)."""
    found, right = label_model(counts)
    w = np.zeros(FEATURES)
    if not sample:
        w[0] = -1.0
        return SpanModel(w, right, lists)
    y = np.array([found[k] for k, _ in sample])
    sizes = np.array([len(f) for _, f in sample])
    row, column = np.repeat(np.arange(len(sample)), sizes), np.concatenate([f for _, f in sample])
    step = 4.0 / float(sizes.max() * len(sample))
    momentum, ahead = w.copy(), w
    for t in range(rounds):  # accelerated gradient steps
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=ahead[column], minlength=len(y)), -30, 30)))
        grad = np.bincount(column, weights=(p - y)[row], minlength=FEATURES) + ridge * ahead
        w = ahead - step * grad
        ahead, momentum = w + t / (t + 3) * (w - momentum), w
    return SpanModel(w, right, lists)


def train(cands: DataFrame, lists: dict[str, frozenset[str]] = GAZETTEERS, train_rows: int = 5000) -> SpanModel:
    """Fit on ``candidates()``: counts by key of all, and at most ``train_rows`` loose candidates a kind for the classifier."""
    rows = cands.select(F.explode("cands").alias("c")).select("c.key", "c.kind", "c.features")
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}
    order = Window.partitionBy("kind").orderBy(F.xxhash64("key", "features"), "key", "features")
    loose = rows.where(F.col("kind") >= len(BASE_KINDS)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= train_rows)
    return fit(counts, sorted((r["key"], list(r["features"])) for r in loose.select("key", "features").collect()), lists)


def accepted_spans(cands: Column, model: SpanModel) -> Column:
    """Strict spans, and loose ones that the classifier takes, by start and kind."""
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    score = lambda c: F.aggregate(c["features"], F.lit(0.0), lambda s, i: s + F.get(weights, i))
    return F.filter(cands, lambda c: (c["kind"] < len(BASE_KINDS)) | (score(c) >= TAKEN))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redactor(model: SpanModel, mask: Callable[[str], str] = lambda kind: f"<{kind.upper()}>") -> Callable[[str | None], str | None]:
    def redact(text: str | None) -> str | None:
        out, last = [], 0
        for start, kind, end, _, found in spans_of(text, model.lists):
            if model.takes(kind, found):
                if start >= last:
                    out += [text[last:start], mask(KINDS[kind])]
                last = max(last, end)
        return text if not last else "".join(out) + text[last:]

    return redact


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted span of ``text_col`` replaced by its kind; overlaps become one."""
    run = redactor(model)

    @F.pandas_udf("string")
    def apply(text: pd.Series) -> pd.Series:
        return text.map(run, na_action="ignore")

    return docs.withColumn(text_col, apply(F.col(text_col)))
