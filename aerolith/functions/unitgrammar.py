"""A grammar of numbers and units written in free words, with dimensions as exponent vectors.

    clause   := words* unit words*
    unit     := factor (("." | "*" | blank) factor | ("/" | "par" | "per" | "pro" | "por") factor)*
    factor   := prefix? base exponent?
    exponent := "^"? "-"? digit | superscript

A parsed unit is a dimension (exponents of kg, m, s, K and of "part of the sky"), a scale and an offset to SI. Dimensionless
counts of the sky (eighths, tenths, percent, fractions) have the dimension ``sky``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Base units as (kg, m, s, K, sky) exponents and their size in SI.
_BASES = {
    "pascal": ((1, -1, -2, 0, 0), 1.0), "pa": ((1, -1, -2, 0, 0), 1.0), "bar": ((1, -1, -2, 0, 0), 1e5), "atm": ((1, -1, -2, 0, 0), 101325.0),
    "torr": ((1, -1, -2, 0, 0), 133.322368), "mmhg": ((1, -1, -2, 0, 0), 133.322368), "inhg": ((1, -1, -2, 0, 0), 3386.389),
    "joule": ((1, 2, -2, 0, 0), 1.0), "j": ((1, 2, -2, 0, 0), 1.0), "watt": ((1, 2, -3, 0, 0), 1.0), "w": ((1, 2, -3, 0, 0), 1.0),
    "wh": ((1, 2, -2, 0, 0), 3600.0), "cal": ((1, 2, -2, 0, 0), 4.184), "langley": ((1, 0, -2, 0, 0), 41840.0), "ly": ((1, 0, -2, 0, 0), 41840.0),
    "m": ((0, 1, 0, 0, 0), 1.0), "metre": ((0, 1, 0, 0, 0), 1.0), "meter": ((0, 1, 0, 0, 0), 1.0), "s": ((0, 0, 1, 0, 0), 1.0), "h": ((0, 0, 1, 0, 0), 3600.0),
    "knot": ((0, 1, -1, 0, 0), 1852 / 3600), "kt": ((0, 1, -1, 0, 0), 1852 / 3600),
    "okta": ((0, 0, 0, 0, 1), 1 / 8), "tenth": ((0, 0, 0, 0, 1), 1 / 10), "percent": ((0, 0, 0, 0, 1), 1 / 100), "fraction": ((0, 0, 0, 0, 1), 1.0),
    "kelvin": ((0, 0, 0, 1, 0), 1.0), "k": ((0, 0, 0, 1, 0), 1.0), "celsius": ((0, 0, 0, 1, 0), 1.0), "fahrenheit": ((0, 0, 0, 1, 0), 5 / 9),
}
_OFFSETS = {"celsius": 273.15, "fahrenheit": 459.67 * 5 / 9}
_PREFIXES = {"hecto": 1e2, "kilo": 1e3, "mega": 1e6, "milli": 1e-3, "centi": 1e-2, "h": 1e2, "k": 1e3, "M": 1e6, "m": 1e-3, "c": 1e-2}
#: Words and signs in several languages, in the spelling of the table above. Longer ones first.
_WORDS = (
    (r"inches of mercury|pouces de mercure|pulgadas de mercurio|zoll quecksilber|in\.? ?hg\b", " inhg "),
    (r"(?:millim[eè]tres?|mm) de mercure|mil[ií]metros de mercurio|mm ?hg\b", " mmhg "),
    (r"part du ciel(?: \(?0 ?[àa-] ?1\)?)?|fraction(?: \(?0 ?[-àa] ?1\)?)?|fracci[oó]n|anteil", " fraction "),
    (r"pour ?cent|per ?cent|prozent|por ciento|%", " percent "),
    (r"dixi[eè]mes?|tenths?|zehntel|d[eé]cim[ao]s?|/ ?10\b", " tenth "),
    (r"huiti[eè]mes?|eighths?|achtel|octav[ao]s?|oktas?|octas?|/ ?8\b", " okta "),
    (r"m[eé]ga", "mega"),
    (r"(?<=[a-zµ])-heures?|watt ?heures?|watt ?hours?|wattstunden?", "wh"),
)
_NAMES = {"pascal": "pascals?", "joule": "joules?|julios?", "watt": "watts?|vatios?", "metre": "m[eè]tres?|met(?:er|re)s?|metros?", "celsius": "°c|celsius", "fahrenheit": "°f|fahrenheit", "kelvin": "kelvins?", "knot": "knots?|n[oœ]uds?|nudos?", "langley": "langleys?"}
_SUPERSCRIPT = str.maketrans("²³⁻¹", "23-1")


@dataclass(frozen=True)
class Unit:
    dimension: tuple[int, int, int, int, int]
    scale: float
    offset: float = 0.0

    def to(self, other: Unit, seconds: float = 3600.0) -> float | None:
        """The factor from this unit to ``other``; a flux is held over ``seconds`` where the other is its sum. None: not comparable."""
        if self.dimension == other.dimension:
            return self.scale / other.scale
        # A flux and its sum: they differ by a second.
        gap = [a - b for a, b in zip(self.dimension, other.dimension, strict=True)]
        if gap == [0, 0, -1, 0, 0]:
            return self.scale * seconds / other.scale
        if gap == [0, 0, 1, 0, 0]:
            return self.scale / seconds / other.scale
        return None


def convert(value: float, unit: Unit, other: Unit, seconds: float = 3600.0) -> float | None:
    """``value`` of ``unit`` in ``other``, with the offsets of temperature scales (a difference or a rate of temperatures has none). None: not comparable."""
    factor = unit.to(other, seconds)
    if factor is None:
        return None
    return value * factor + (unit.offset - other.offset) / other.scale


_ATOM = re.compile(
    r"(?i:(?P<pre>hecto|kilo|mega|milli|centi)?(?P<long>" + "|".join(f"(?P<x_{k}>{v})" for k, v in _NAMES.items()) + r"|okta|tenth|percent|fraction|inhg|mmhg|torr|atm|wh|cal))"
    r"(?P<e1>\^?-?[1-9])?(?![A-Za-z])|(?P<p2>[hkMmc])?(?P<short>Pa|pa|PA|bar|Wh|W|J|m|s|h|K|kt|ly|cal|w|j)(?P<e2>\^?-?[1-9])?(?![A-Za-z])"
)
_UNIT_START = re.compile(r"(?<![A-Za-z0-9µ°])(?:" + _ATOM.pattern + ")")
_OVER = re.compile(r"\s*(?:/|\b(?:par|per|pro|por)\b)\s*")
_TIMES = re.compile(r"\s*[.*·]\s*|\s+")


def _power(text: str | None) -> int:
    return int(text.replace("^", "")) if text else 1


def _plain(text: str) -> str:
    t = text.translate(_SUPERSCRIPT)
    for pattern, word in _WORDS:
        t = re.sub(pattern, word, t, flags=re.IGNORECASE)
    return re.sub(r"[ \t\xa0 ]+", " ", t).strip()


def _factor(m: re.Match) -> Unit:
    if m["long"]:
        name = next((k for k in _NAMES if m[f"x_{k}"]), m["long"].lower())
        prefix, power = _PREFIXES.get((m["pre"] or "").lower(), 1.0), _power(m["e1"])
    else:
        name, prefix, power = m["short"].lower(), _PREFIXES.get(m["p2"] or "", 1.0), _power(m["e2"])
    dim, size = _BASES[name]
    return Unit(tuple(d * power for d in dim), (prefix * size) ** power, _OFFSETS.get(name, 0.0))  # type: ignore[arg-type]


def units_in(text: str) -> list[Unit]:
    """Units written in ``text``, in order."""
    t, at, out = _plain(text), 0, []
    while m := _UNIT_START.search(t, at):
        unit, pos = _factor(m), m.end()
        while True:
            over, times = _OVER.match(t, pos), _TIMES.match(t, pos)
            step = over or times
            nxt = step and _ATOM.match(t, step.end())
            if not nxt or (not over and not times):
                break
            f = _factor(nxt)
            sign = -1 if over else 1
            # A product or quotient counts differences, so its parts' offsets are gone.
            unit = Unit(tuple(a + sign * b for a, b in zip(unit.dimension, f.dimension, strict=True)), unit.scale * f.scale**sign)  # type: ignore[arg-type]
            pos = nxt.end()
        out.append(unit)
        at = pos
    return out


#: Names under which notes speak of a quantity. Single letters count only as capitals.
QUANTITY_NAMES = {
    "GLO": r"rayonnement global(?: horaire)?|ray\. ?global|global radiation|globalstrahlung|radiaci[oó]n global|\bglo\b",
    "PSTAT": r"station pressure|pression(?: station)?|luftdruck|presi[oó]n(?: de la estaci[oó]n)?|\bpstat\b|(?-i:(?<![A-Za-z0-9])P(?![A-Za-z0-9]))",
    "N": r"couverture nuageuse|n[eé]bulosit[eé](?: totale)?|cloud cover|bedeckung|nubosidad|(?-i:(?<![A-Za-z0-9])N(?![A-Za-z0-9]))",
    "INFRAR": r"longwave down|rayt\.? ?ir|ir atm\.?|infrarouge|infrared|infrarrojo|\binfrar\b",
}
CANONICAL = {
    "GLO": Unit((1, 0, -2, 0, 0), 1e4),
    "PSTAT": Unit((1, -1, -2, 0, 0), 100.0),
    "N": Unit((0, 0, 0, 0, 1), 1 / 8),
    "INFRAR": Unit((1, 0, -2, 0, 0), 1e4),
}
_QUANTITY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in QUANTITY_NAMES.items()), re.IGNORECASE)
_CLAUSE = re.compile(r"[\n;|]|, | / ")


@lru_cache(maxsize=65536)
def read_note(text: str | None) -> dict[str, float]:
    """Factors to the canonical unit of each quantity that ``text`` names together with a unit of its kind.

    A clause counts only if it holds one quantity and a unit that can be converted to it; clauses that name a unit but no
    quantity (a remark that some unit is no longer used, say) say nothing.
    """
    out: dict[str, float] = {}
    for clause in _CLAUSE.split(text or ""):
        found = list(_QUANTITY.finditer(clause))
        for i, m in enumerate(found):
            q = m.lastgroup
            after = clause[m.end() : found[i + 1].start() if i + 1 < len(found) else len(clause)]
            before = clause[found[i - 1].end() if i else 0 : m.start()]
            for part in (after, before):
                factor = next((f for u in units_in(part) if (f := u.to(CANONICAL[q])) is not None), None)
                if factor is not None:
                    out.setdefault(q, round(factor, 9))
                    break
    return out


_NUMBER = re.compile(r"[-+]?(?:\d{1,3}(?:[ \xa0 ']\d{3})+|\d+)(?:[.,]\d+)?(?:[eE][-+]?\d+)?")


def read_quantity(text: str | None) -> tuple[float, Unit] | None:
    """A number and its unit out of text such as ``1 013,2 hPa`` (value, unit), or None."""
    m = _NUMBER.search(text or "")
    if not m:
        return None
    units = units_in(text[m.end() :])
    return (float(re.sub(r"[ \xa0 ']", "", m[0]).replace(",", ".")), units[0]) if units else None
