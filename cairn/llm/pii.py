"""Personal data: candidate spans judged by gradient-boosted trees, all in DataFrame functions.

Base spans (email, ip, card, phone) follow fixed formats and always stay. Besides, high-recall generators propose spans that may overlap
(local phone numbers, bank accounts, spelled-out addresses, dates of birth, document numbers, postal addresses, handles, long digit strings);
boosted trees score them from format and context features, and a threshold calibrated on examples set aside selects those to redact,
where they do not overlap a base span.

The trees are fitted on the driver to a fixed number of example candidates generated by rule (`EXAMPLES`, whatever the corpus), whose features come
from the same column expressions, and are then written out as CASE expressions: the texts are scored in the JVM without Python. Examples of one format stand on both sides, so that
what is around a number decides: 16 digits after `card` or `account` are personal and after `order` or `tracking` are not; without any such word they are if they
begin as an issuer's cards do.
Positions are running sums of the lengths of matches and of the pieces between them, taken in doubling steps (n log n for n matches).

Null and empty texts have no spans. Offsets are code points, end exclusive. Rows are judged one by one, equal rows alike; other
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table

# A match starts where a run of its characters starts or where the last match ended, so long runs are not scanned again from each place.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![A-Za-z0-9.,+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,8}(?:[\x20./-][0-9]{2,5}){0,4}+(?![A-Za-z0-9])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SPELLED = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?[\[({.](?:dot)?[\])}]?\x20?[A-Za-z0-9-]++)++"
    r"|(?<![A-Za-z0-9])[A-Za-z0-9]{1,20}(?:\x20dot\x20[A-Za-z0-9]{1,20}){0,3}\x20at\x20[A-Za-z0-9-]{2,30}(?:\x20dot\x20[a-z]{2,12}){1,3}(?![A-Za-z0-9])"
)
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Mär|Mai|Okt|Dez|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)[a-zé]{0,6}"
BIRTH = (
    r"(?<![A-Za-z0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}"
    rf"|[0-9]{{1,2}}\.?\x20(?:of\x20|de\x20)?{MONTH}\x20(?:de\x20)?(?:19|20)[0-9]{{2}}|{MONTH}\x20[0-9]{{1,2}},?\x20(?:19|20)[0-9]{{2}})(?![A-Za-z0-9])"
)
PAPER = r"(?<![A-Za-z0-9])(?:[A-Z]{1,3}[0-9]{6,10}|(?=[A-Z]*[0-9][A-Z]*[0-9][A-Z]*[0-9])[A-Z][A-Z0-9]{8,9})(?![A-Za-z0-9])"
ADDRESS = (
    r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Z]?\x20(?:[A-Z][A-Za-z]{2,20}\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Square)(?![A-Za-z])"
    r"|(?<![A-Za-z])(?:[A-Z][a-zäöüß]{2,20}(?:straße|strasse|str\.|weg|platz|gasse)|(?:rue|avenue|calle|avenida|plaza)\x20(?:de\x20|du\x20|des\x20)?(?:la\x20|los\x20|las\x20)?[A-Z][a-zà-ÿ]{2,20}),?\x20[0-9]{1,4}(?![0-9])"
    r"|(?<![A-Za-z0-9])[0-9]{1,4}(?:\x20bis)?,?\x20(?:rue|avenue|boulevard|place|impasse)\x20(?:de\x20|du\x20|des\x20)?(?:la\x20)?[A-Z][a-zà-ÿ]{2,20}(?![A-Za-z])"
)
SITES = "discord|telegram|twitter|instagram|github|reddit|snapchat|signal|tiktok|steam"
HANDLE = rf"(?<![A-Za-z0-9._%+/@-])(?:@[A-Za-z0-9_]{{3,30}}(?![A-Za-z0-9_@.-])|[A-Za-z][A-Za-z0-9_.]{{2,30}}(?=\x20on\x20(?:{SITES})(?![a-z])))"
DIGITS = r"(?<![A-Za-z0-9.,+-])[0-9]{9,19}(?![A-Za-z0-9])"
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "account", "spelled", "birth", "paper", "address", "handle", "digits")
EXAMPLES = 2400
CONTEXT = 24
FEATURES = (
    "digits", "length", "groups", "first_group", "last_group", "parens", "dashes", "dots", "slashes", "spaces", "date", "first_one", "cue_phone", "cue_id", "cue_bank", "cue_birth", "cue_place", "cue_person", "cue_count", "money", *(f"is_{k}" for k in ADDED),
    "first_zero", "issuer", "goes_on", "keyword", "cue_item", "round", "month", "site",
)


def _matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if guard is None else F.when(guard, found).otherwise(F.array().cast("array<string>"))


def _running(values: str, n: str, op: str) -> str:
    """SQL: of each of n values the result of `op` (over x and y) over it and all before it, in doubling steps."""
    steps = ", ".join(str(1 << j) for j in range(31))
    return f"aggregate(filter(array({steps}), s -> s < {n}), {values}, (acc, s) -> transform(acc, (x, i) -> {op.replace('y', 'get(acc, i - s)')}))"


def _pieces(found: str, text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches in column `found`."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def _placed(found: str, pieces: str, kind: int, context: bool = False) -> Column:
    """Spans (start, kind, end, m) of the matches in column `found`; with context also what stands before and after each."""
    n = f"size({found})"
    ends = _running(f"transform(arrays_zip({found}, slice({pieces}, 1, {n})), x -> length(x.{found}) + length(x.`1`))", n, "x + coalesce(y, 0)")
    span = f"'start', x.`1` - length(x.{found}), 'kind', {kind}, 'end', x.`1`, 'm', x.{found}"
    around = ""
    if context:  # the pieces on both sides, and the matches beyond them
        around = f", slice(concat(array(''), {found}), 1, {n}), slice({pieces}, 1, {n}), slice({pieces}, 2, {n}), slice(concat({found}, array('')), 2, {n})"
        span += f", 'before', lower(substring(concat(x.`2`, x.`3`), -{CONTEXT}, {CONTEXT})), 'after', substring(concat(x.`4`, x.`5`), 1, 16)"
    return F.expr(f"case when {n} > 0 then transform(arrays_zip({found}, {ends}{around}), x -> named_struct({span})) else array() end")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    at = F.sequence(F.lit(1), F.length(digits))
    d = lambda i: F.element_at(F.split(F.reverse(digits), ""), i).cast("int")
    worth = F.transform(at, lambda i: F.when(i % 2 == 0, d(i) * 2 - F.when(d(i) > 4, 9).otherwise(0)).otherwise(d(i)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str):
    if kind == "ip":
        return lambda s: s["m"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return lambda s: F.length(_digits(s["m"])).between(14, 19) & luhn(_digits(s["m"]))
    if kind == "phone":
        return lambda s: F.length(_digits(s["m"])).between(10, 15)
    return lambda s: F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `base`: spans (start, kind, end, m) of the fixed formats, by start and kind."""
    text = F.col("text")
    guards = {"email": text.contains("@"), "ip": text.contains("."), "card": None, "phone": text.contains("+")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    out = docs.select("*", *(_matches(text, patterns[k], guards[k]).alias(f"m_{k}") for k in BASE))
    out = out.select("*", *(_pieces(f"m_{k}", text, patterns[k]).alias(f"p_{k}") for k in BASE))
    out = out.select("doc_id", "text", *(F.filter(_placed(f"m_{k}", f"p_{k}", i), _valid(k)).alias(f"s_{k}") for i, k in enumerate(BASE)))
    return out.select("doc_id", "text", F.array_sort(F.concat(*(f"s_{k}" for k in BASE))).alias("base"))


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `found`: spans that the generators propose, with what stands around them; kinds go on from those of the base."""
    text = F.col("text")
    patterns = {"number": NUMBER, "account": ACCOUNT, "spelled": SPELLED, "birth": BIRTH, "paper": PAPER, "address": ADDRESS, "handle": HANDLE, "digits": DIGITS}
    guards = {
        "number": text.rlike("[0-9][\\x20./)-]+[0-9]"), "account": text.rlike("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}"), "spelled": text.rlike("[\\[({]at[\\])}]|\\x20dot\\x20"), "birth": text.rlike("[0-9][./-][0-9]{1,2}[./-][0-9]|\\x20(?:19|20)[0-9]{2}"),
        "paper": text.rlike("[A-Z][0-9]{6}|[A-Z][A-Z0-9]{8}"), "address": text.rlike("[0-9][A-Z]?\\x20[A-Z]|[a-zß.],?\\x20[0-9]|[0-9],?\\x20[a-z]"), "handle": text.contains("@") | text.rlike(f"\\x20on\\x20(?:{SITES})"), "digits": text.rlike("[0-9]{9}"),
    }
    out = docs.select("*", *(_matches(text, patterns[k], guards[k]).alias(f"m_{k}") for k in ADDED))
    out = out.select("*", *(_pieces(f"m_{k}", text, patterns[k]).alias(f"p_{k}") for k in ADDED))
    placed = F.concat(*(_placed(f"m_{k}", f"p_{k}", len(BASE) + i, True) for i, k in enumerate(ADDED)))
    return out.withColumn("found", placed).drop(*(f"{c}_{k}" for k in ADDED for c in "mp"))


def features(span: Column) -> list[Column]:
    """Numbers of a span that the trees see, as FEATURES."""
    m, before, after, next_ = span["m"], span["before"], F.lower(span["after"]), span["after"]
    n = lambda c: (F.length(m) - F.length(F.translate(m, c, ""))).cast("int")
    flag = lambda c: c.cast("int")
    return [
        F.length(_digits(m)), F.length(m), F.size(F.split(m, r"[^A-Za-z0-9]+")), F.length(F.regexp_extract(m, "[0-9]+", 0)), F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)),
        n("()"), n("-"), n("."), n("/"), n(" "), flag(m.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{2}(?:[./-][0-9]{2})?|[0-9]{2}[./-][0-9]{2}[./-](?:19|20)[0-9]{2})")), flag(m.rlike("^(?:1[4-9]|20)[0-9]")),
        flag(before.rlike(r"(?:phone|tel|call|mobile|fax|cell|kontakt|contact|whatsapp)[^a-z]")), flag(before.rlike(r"(?:ssn|social|passport|insurance|id|tax|licen[cs]e|ausweis|dni)[^a-z]")),
        flag(before.rlike(r"(?:iban|account|bank|konto|cuenta|compte|card|karte|carte|tarjeta)[^a-z]")), flag(before.rlike(r"(?:born|birth|dob|geboren|geb\.|naci|nacimiento|née?|naissance)[^a-z]")),
        flag(before.rlike(r"(?:live[sd]?|address|at|wohnt|adresse|vive en|habite|ship to|deliver to)[^a-z]+$")), flag(before.rlike(r"(?:follow|user|by|dm|handle|profile|ask|ping|instagram|twitter)[^a-z]+$")),
        flag(before.rlike(r"(?:version|page|section|room|isbn|chapter|no\.|nr\.|#|year|order|part|flight|model|at line|time|stamp)[^a-z]*$")), flag(before.rlike(r"[$€£]\x20?$") | after.rlike(r"^\x20?(?:%|usd|eur|km|kg|mb|dollars|ms)")),
        *(flag(span["kind"] == len(BASE) + i) for i in range(len(ADDED))),
        flag(m.rlike(r"^\(?0")), flag(m.rlike(r"^(?:4[0-9]{15}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6[05][0-9]{14})$")), flag(next_.rlike(r"^\x20[A-Z][a-z]")),
        flag(m.rlike("(?i)^@(?:media|import|charset|keyframes|font_face|supports|page|layer|param|return|returns|throws|see|since|deprecated|author|override|test|before|after|bean|autowired|inject|property|staticmethod|classmethod|dataclass|todo|here|all|everyone|channel)$")),
        flag(before.rlike(r"(?:track|parcel|shipment|order|invoice|serial|hash|reference|ref|sku|ticket|batch|build|commit|product|item|lot|code|checksum|seed|record|row|offset|barcode|isbn|ean|imei|key|index|case|transaction|receipt|rechnung|bestell|sendung|pedido|factura|commande|facture)[^0-9]{0,14}$")),
        flag(m.rlike(r"(?:00|024|048|096|192|256|512)(?![0-9])")), flag(m.rlike("[a-zé]{3}")), flag(after.rlike(rf"^\x20on\x20(?:{SITES})")),
    ]


def examples(count: int = EXAMPLES, seed: int = 6) -> list[tuple[int, str, int]]:
    """(index, text, 1 if its candidate is personal) made by rule."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    c = lambda *xs: r.choice(xs)
    up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVXYZ") for _ in range(n))
    name = lambda: c("Maple", "Hill", "Garden", "Station", "Church", "Lindo", "Bergen", "Mozart")
    day, month, year = lambda: f"{r.randint(1, 28):02}", lambda: f"{r.randint(1, 12):02}", lambda: str(r.randint(1920, 2024))
    filler = ("the report says", "we walked along", "and later", "in the end", "as of today", "der bericht", "en la casa", "ouéré ment", "tion the", "los de una")
    month_name = lambda: c("January", "March", "May", "June", "Oct", "Dec", "Mai", "Okt", "enero", "de julio", "août", "mars")
    item = lambda: c("tracking code", "tracking", "order number", "order", "invoice", "serial", "serial no.", "hash id", "reference", "sku", "ticket", "product", "batch", "receipt no", "Rechnung", "Sendung", "pedido", "commande", "transaction id", "imei")
    issued = lambda: c("4" + d(15), "5" + c(*"12345") + d(14), "6011" + d(12))
    plain = lambda: c("1", "7", "8", "9", "0") + d(15)
    site = lambda: c(*SITES.split("|"))
    person = (
        lambda: f"{c('phone', 'tel.', 'call me at', 'mobile:', 'contact')} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{c('phone', 'call', 'fax:')} {d(3)}-{d(3)}-{d(4)}", lambda: f"{c('tel:', 'mobile', 'cell')} {d(4)} {d(3)} {d(3)}",
        lambda: f"{c(*filler)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{c('ssn', 'social', 'id:', 'tax id', 'my social is')} {c(f'{d(3)}-{d(2)}-{d(4)}', d(9))}", lambda: f"{c('iban', 'account', 'bank', 'pay to')} {c('DE', 'FR', 'ES', 'GB')}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        lambda: f"{c('write to', 'mail', 'ask', *filler)} {c('anna', 'j.doe', 'max')}[at]example{c('[dot]', ' (dot) ')}org", lambda: f"{c('write to', 'mail me', *filler)} {c('anna', 'j dot doe', 'max')} at {c('example', 'mail-box', 'web')} dot {c('org', 'com', 'de')}",
        lambda: f"{c('born', 'born on', 'date of birth:', 'dob', 'geboren am', 'née le', 'naci')} {c(f'{day()}.{month()}.{year()}', f'{year()}-{month()}-{day()}', f'{month()}/{day()}/{year()}', f'{r.randint(1, 28)} {month_name()} {year()}', f'May {r.randint(1, 28)}, {year()}')}",
        lambda: f"{c('passport', 'passport no:', 'id card', 'driving licence', 'ausweis', 'dni')} {c(up(r.randint(1, 2)) + d(r.randint(6, 9)), f'{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}')}", lambda: f"{c('lives at', 'address:', 'ship to', 'deliver to', *filler)} {d(r.randint(1, 4))}{c('', '', 'B')} {name()} {c('Street', 'Road', 'Avenue', 'Lane')}",
        lambda: f"{c('wohnt', 'adresse', *filler)} {name()}{c('straße', 'weg', 'platz')} {r.randint(1, 200)}", lambda: f"{c('habite', 'vive en', *filler)} {c('rue de', 'calle', 'avenue')} {name()} {r.randint(1, 200)}", lambda: f"{c('habite', 'adresse', *filler)} {r.randint(1, 200)} {c('rue de la', 'rue du', 'avenue')} {name()}",
        lambda: f"{c('follow', 'dm', 'ping', 'by', 'instagram', 'twitter:', 'ask', *filler)} @{c('anna', 'j_doe', 'max', 'kim')}{c('', d(2), '_x')}", lambda: f"{c('i am', 'find', 'ask', *filler)} {c('jane_doe', 'max.k', 'anna', 'kim_x')}{c('', d(2), '_' + d(2))} on {site()}",
        lambda: f"{c('card', 'account', 'bank', 'konto', 'carte', 'tarjeta', 'pay with')} {c(issued(), plain())}", lambda: f"{c(*filler)} {issued()}", lambda: f"{c('card', 'account', 'carte', 'konto')} {d(r.randint(12, 19))}",
        lambda: f"{c('tel', 'call', 'mobil', *filler)} 0{d(r.randint(2, 3))}{c(' ', '-', '/')}{d(r.randint(6, 8))}", lambda: f"{c('tel', 'call', 'mobil', *filler)} 0{d(r.randint(2, 3))} {d(3)} {d(4)}",
    )
    other = (
        lambda: f"{c(*filler)} {year()}-{month()}-{day()}", lambda: f"{c(*filler)} {day()}.{month()}.{year()}", lambda: f"{c(*filler)} {r.randint(1, 9)}/{day()}/{year()}", lambda: f"{c('on', 'since', 'am', *filler)} {c(f'{r.randint(1, 28)} {month_name()} {year()}', f'May {r.randint(1, 28)}, {year()}')}", lambda: f"version {d(2)}.{d(2)}.{d(2)}",
        lambda: f"$ {d(3)} {d(3)}", lambda: f"{c(*filler)} {d(2)}/{d(2)}", lambda: f"page {d(3)}-{d(3)}", lambda: f"isbn {d(3)}-{d(2)}-{d(5)}-{d(3)}", lambda: f"{c(*filler)} {d(3)} {d(3)} km", lambda: f"{c(*filler)} {d(2)} {d(2)} {d(2)}",
        lambda: f"{c('sizes', 'values', *filler)} {c('/', ' ', '-').join(str(r.randint(1, 9) * 100) for _ in range(3))}", lambda: f"{c('sizes', 'blocks of', *filler)} {' '.join(c('1024', '2048', '4096', '8192', d(4)) for _ in range(3))}", lambda: f"{c(*filler)} {c('19', '20')}{d(2)}-{c('19', '20')}{d(2)}",
        lambda: f"{c('order', 'ticket', 'invoice')} {d(3)}-{d(4)}", lambda: f"part AB{d(2)} {'X' * 4} {d(4)} {'Q' * 4}", lambda: f"{c('part', 'model', 'flight', *filler, item())} {c(up(r.randint(1, 3)) + d(r.randint(6, 10)), f'{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}')}", lambda: f"{c('time', 'stamp', 'at', *filler)} 1{c('4', '5', '6', '7')}{d(c(8, 11))}",
        lambda: f"{c('time', 'stamp', *filler)} {year()}{month()}{day()}{d(6)}", lambda: f"{c('decorate with', 'annotate', 'java', 'import', 'use the', 'css', *filler)} @{c('Override', 'param', 'return', 'media', 'import', 'Test', 'deprecated')}", lambda: f"{item()} {c(issued(), plain(), plain())}", lambda: f"{item()} {d(r.randint(9, 19))}", lambda: f"{c(*filler)} {d(c(9, 10, 11, 12, 13))}",
        lambda: f"{c(*filler)} {plain()}", lambda: f"{c('the', 'read the', 'by', *filler)} {d(r.randint(1, 2))} {name()} {c('Street', 'Road', 'Place')} {c('Journal', 'Band', 'Partners', 'Quartet', 'Records', 'Studios')}", lambda: f"{c('look', 'meet', 'stay')} at {c('home', 'example', 'work')} dot {c('the', 'and', 'in')}", lambda: f"{c('based', 'works', 'posted', 'news')} on {site()}",
        lambda: f"{item()} 0{d(r.randint(2, 3))}{c(' ', '-', '/')}{d(r.randint(6, 8))}", lambda: f"{c('room', 'section', 'no.', item())} {d(3)}-{d(r.randint(2, 4))}",
    )
    told = lambda t, y: t if y else re.sub("[0-9]{14,19}", lambda m: _failing(m[0]), t)  # noqa: E731  a number that passes the checksum is a base span
    return [(i, told((lambda t: t + c("", " and", ".", ", or"))(r.choice(person if i % 2 else other)()), i % 2), i % 2) for i in range(count)]


def _failing(digits: str) -> str:
    """digits, the last one changed where they pass the checksum of cards."""
    total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return digits if total % 10 else digits[:-1] + str((int(digits[-1]) + 1) % 10)


def fit_trees(rows: list[list[float]], labels: list[int], rounds: int = 32, rate: float = 0.3, depth: int = 3) -> list:
    """Gradient-boosted trees for the logistic loss; a tree is a leaf value or (feature, limit, below or at, above)."""
    x, y, score, trees = np.asarray(rows, float).reshape(len(rows), len(FEATURES)), np.asarray(labels, float), np.zeros(len(rows)), []

    def grow(own: np.ndarray, grad: np.ndarray, hess: np.ndarray, left: int):
        g, h = grad[own].sum(), hess[own].sum()
        best = (1e-6, None)
        for f in range(len(FEATURES)) if left and len(own) else ():
            order = own[np.argsort(x[own, f], kind="stable")]
            cut = np.flatnonzero(np.diff(x[order, f]))
            if len(cut):
                gl, hl = grad[order].cumsum()[cut], hess[order].cumsum()[cut]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, float(x[order[cut[k]], f])))
        if best[1] is None:
            return float(rate * g / (h + 1))
        f, limit = best[1]
        low = x[own, f] <= limit
        return (f, limit, grow(own[low], grad, hess, left - 1), grow(own[~low], grad, hess, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        t = grow(np.arange(len(x)), y - p, p * (1 - p), depth)
        trees.append(t)
        score = score + [value(t, v) for v in x]
    return trees


def value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql(tree, of: str) -> str:
    """A tree as SQL over the features of the struct `of`."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"case when {of}.{FEATURES[tree[0]]} <= {tree[1]!r}D then {_sql(tree[2], of)} else {_sql(tree[3], of)} end"


@lru_cache(maxsize=4)
def model(spark: SparkSession, precision: float = 0.98) -> tuple[list, float]:
    """Trees, and the least score at which the examples set aside reach the precision."""
    made = examples()
    shown = spark.sql("select * from values " + ", ".join(f"({i}L, '{t}')" for i, t, _ in made) + " as t(doc_id, text)")
    found = candidates(shown).select("doc_id", F.explode("found").alias("s"))
    got = found.select("doc_id", *(f.alias(n) for f, n in zip(features(F.col("s")), FEATURES, strict=True))).collect()  # a fixed number of rows
    rows, labels = [[float(r[n]) for n in FEATURES] for r in sorted(got)], [made[r["doc_id"]][2] for r in sorted(got)]
    ids = [r["doc_id"] for r in sorted(got)]
    train = [k for k, i in enumerate(ids) if i % 3 or i % 2 and i % 9 == 0]
    trees = fit_trees([rows[k] for k in train], [labels[k] for k in train])
    aside = sorted(((sum(value(t, rows[k]) for t in trees), labels[k]) for k in range(len(ids)) if k not in set(train)), reverse=True)
    limit, hits = aside[0][0] if aside else 0.0, 0
    for n, (s, y) in enumerate(aside, 1):
        hits += y
        if hits >= precision * n:
            limit = s
    return trees, max(limit - 1e-9, 0.0)


def _free() -> Column:
    """`found` without the spans that overlap one of `base`. Ends of found spans and starts of base spans are walked in order, with the
    farthest end of a base span so far."""
    asked = "transform(found, s -> named_struct('at', s.end, 'what', 0, 'other', s.start, 'span', s))"
    starts = "transform(base, s -> named_struct('at', s.start, 'what', 1, 'other', s.end, 'span', cast(null as struct<start:int,kind:int,end:int,m:string,before:string,after:string>)))"
    walk = f"array_sort(concat({asked}, {starts}))"
    far = _running(f"transform({walk}, e -> if(e.what = 1, e.other, -1))", "size(base) + size(found)", "greatest(x, y)")
    kept = f"transform(filter(arrays_zip({walk}, {far}), z -> z.`0`.what = 0 and z.`1` <= z.`0`.other), z -> z.`0`.span)"
    return F.expr(f"case when size(base) = 0 or size(found) = 0 then found else {kept} end")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, kind, end, m): base spans, and the others that the trees select."""
    trees, limit = model(docs.sparkSession)
    rows = candidates(base_spans(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))))
    rows = rows.select("doc_id", "base", _free().alias("found"))
    seen = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["m"].alias("m"), *(f.alias(n) for f, n in zip(features(s), FEATURES, strict=True))))
    rows = rows.select("doc_id", "base", F.when(F.size("found") > 0, seen).alias("seen"))
    likely = F.expr(f"filter(seen, x -> {' + '.join(_sql(t, 'x') for t in trees)} >= {limit!r}D)")
    chosen = F.transform(likely, lambda x: F.struct(*(x[k].alias(k) for k in ("start", "kind", "end", "m"))))
    return rows.select("doc_id", "base", F.array_sort(F.when(F.col("seen").isNull(), F.col("base")).otherwise(F.concat("base", chosen))).alias("spans"))


def _said(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in (*BASE, *ADDED)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    of = lambda i: F.filter("base", lambda s: s["kind"] == i)
    n = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the base formats alone, which SQL can say."""
    return op6_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in BASE))


QUERIES = {"op6_pii": op6_pii, "pii_base_counts": pii_base_counts}
_LUHN = "list_sum(list_transform(generate_series(1, length(x)), lambda i: case when i % 2 = 1 then substr(reverse(x), i, 1)::int when substr(reverse(x), i, 1)::int > 4 then substr(reverse(x), i, 1)::int * 2 - 9 else substr(reverse(x), i, 1)::int * 2 end)) % 10 = 0"
ORACLE_SQL = {
    "pii_base_counts": r"""
select doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
    len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 or coalesce(nullif(ltrim(y, '0'), ''), '0')::int > 255)) = 0)) as n_ip,
    len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) between 14 and 19 and """
    + _LUHN
    + r""")) as n_card,
    len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 10 and 15)) as n_phone
from (select doc_id, coalesce(text, '') as t from documents)"""
}
