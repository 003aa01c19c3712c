"""Registration answers (RDAP JSON) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import registry_time

_ENTITY = "struct<roles:array<string>,vcardArray:array<string>,handle:string>"
ANSWER = (
    f"struct<events:array<struct<eventAction:string,eventDate:string>>,entities:array<{_ENTITY}>,nameservers:array<struct<ldhName:string,unicodeName:string,name:string>>,"
    "registrarName:string,registrar:string,sponsor:string,name:string,handle:string,port43:string,country:string>"
)


def answer(json: Column) -> Column:
    """The answer as a struct; vCards stay JSON texts, as their entries are of mixed types."""
    return F.from_json(json, ANSWER)


def _event(a: Column, action: str) -> Column:
    dates = F.transform(F.filter(a["events"], lambda e: e["eventAction"] == action), lambda e: registry_time(e["eventDate"]))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def created(a: Column) -> Column:
    return _event(a, "registration")


def expires(a: Column) -> Column:
    return _event(a, "expiration")


def _card(entity: Column, names: tuple[str, ...], empty_too: bool) -> Column:
    """The value of the first vCard entry of one of the names."""
    entries = F.from_json(F.get(entity["vcardArray"], F.lit(1)), "array<array<string>>")
    named = F.filter(entries, lambda e: F.get(e, F.lit(0)).isin(*names) & (F.lit(empty_too) | (F.coalesce(F.get(e, F.lit(3)), F.lit("")) != "")))
    return F.get(F.get(named, F.lit(0)), F.lit(3))


def _first_named(entities: Column, names: tuple[str, ...], empty_too: bool) -> Column:
    values = F.transform(entities, lambda e: F.coalesce(_card(e, names, empty_too), F.nullif(e["handle"], F.lit(""))))
    return F.coalesce(F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)), F.lit(""))


def _with_role(a: Column, role: str) -> Column:
    return F.filter(a["entities"], lambda e: F.exists(F.coalesce(e["roles"], F.array().cast("array<string>")), lambda r: F.lower(r) == role))


def registrant(a: Column) -> Column:
    return F.coalesce(_first_named(_with_role(a, "registrant"), ("fn",), True), F.lit(""))


def registrar(a: Column) -> Column:
    direct = [F.nullif(a[k], F.lit("")) for k in ("registrarName", "registrar", "sponsor")]
    return F.coalesce(*direct, _first_named(_with_role(a, "registrar"), ("fn", "org"), False), F.lit(""))


def nameservers(a: Column) -> Column:
    names = F.transform(a["nameservers"], lambda n: F.lower(F.regexp_replace(F.coalesce(F.nullif(n["ldhName"], F.lit("")), F.nullif(n["unicodeName"], F.lit("")), n["name"], F.lit("")), r"^\.+|\.+$", "")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), F.array().cast("array<string>"))


def address_owner(a: Column) -> Column:
    """The organisation of an address block.  The block's own name stands; where it has none, the first entity that has a
    fitting role (or none at all) and a name gives it."""
    own = F.coalesce(*(F.nullif(a[k], F.lit("")) for k in ("name", "handle", "port43", "country")), F.lit(""))
    roles = ("registrant", "administrative", "technical", "abuse")
    fitting = F.filter(a["entities"], lambda e: (F.size(F.coalesce(e["roles"], F.array().cast("array<string>"))) == 0) | F.exists(e["roles"], lambda r: F.lower(r).isin(*roles)))
    # The first fitting entity's card replaces the block's name; after it the search ends if there is any name.
    first = F.get(fitting, F.lit(0))
    card = _card(first, ("fn", "org"), False)
    cards = F.filter(F.transform(fitting, lambda e: _card(e, ("fn", "org"), False)), lambda v: v.isNotNull())
    return F.when(own != "", F.coalesce(card, own)).otherwise(F.coalesce(F.get(cards, F.lit(0)), F.lit("")))
