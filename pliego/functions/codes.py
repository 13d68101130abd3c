"""What a scanned code says: a link, a network, mail, a telephone, a contact or plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("tipo", "texto", "url", "sitio", "seguro", "red", "clave", "seguridad", "oculta", "correo", "telefono", "nombre")


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, r'\\([\;,:"])', "$1")


def fields(text: Column, separator: str = ";") -> Column:
    """The key:value fields of a code as array of struct(k, v): keys in upper case, values without escapes."""
    parts = F.filter(F.split(text, rf"(?<!\\){separator}"), lambda p: F.instr(p, ":") > 1)
    return F.transform(parts, lambda p: F.struct(F.upper(F.substring_index(p, ":", 1)).alias("k"), _plain(F.substr(p, F.instr(p, ":") + 1)).alias("v")))


def field(of: Column, key: str) -> Column:
    """The value of the last field of that key, an empty string without one."""
    values = F.transform(F.filter(of, lambda f: f["k"] == key), lambda f: f["v"])
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))


def _line(text: Column, key: str) -> Column:
    """What follows the colon in a card's first line that starts with key."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.startswith(F.upper(x), F.lit(key)))
    return F.trim(F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), r"^[^:]*:", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def classify(text: Column) -> Column:
    """struct of FIELDS; those that a kind doesn't have are null. A link that can't be parsed is text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    is_ = lambda pattern: F.rlike(t, F.lit(pattern))
    url = F.when(is_(r"(?i)^www\."), F.concat(F.lit("https://"), t)).otherwise(t)
    link = (is_(r"(?i)^https?://") | is_(r"(?i)^www\.\S+\.\S+$")) & F.coalesce(F.length(F.try_parse_url(url, F.lit("HOST"))) > 0, F.lit(False))
    wifi, mat, me = (fields(F.regexp_replace(F.substr(t, F.lit(n)), ";;$", "")) for n in (6, 8, 8))

    def made(kind: str, **values: Column) -> Column:
        types = {"seguro": "boolean", "oculta": "boolean"}
        return F.struct(*[(F.lit(kind) if f == "tipo" else t if f == "texto" else values.get(f, F.lit(None)).cast(types.get(f, "string"))).alias(f) for f in FIELDS])

    name = lambda value, cut: F.trim(F.array_join(F.reverse(F.split(value, cut)), " "))
    return (
        F.when(link, made("enlace", url=url, sitio=host(url), seguro=F.startswith(F.lower(url), F.lit("https:"))))
        .when(is_("(?i)^WIFI:"), made("wifi", red=field(wifi, "S"), clave=field(wifi, "P"), seguridad=F.coalesce(F.nullif(F.upper(field(wifi, "T")), F.lit("")), F.lit("nopass")), oculta=field(wifi, "H") == "true"))
        .when(is_("(?i)^mailto:"), made("correo", url=t, correo=F.try_url_decode(F.replace(F.substring_index(F.substr(t, F.lit(8)), "?", 1), F.lit("+"), F.lit("%2B")))))
        .when(is_("(?i)^MATMSG:"), made("correo", url=F.concat(F.lit("mailto:"), field(mat, "TO")), correo=field(mat, "TO")))
        .when(is_("(?i)^tel:"), made("telefono", url=t, telefono=F.substr(t, F.lit(5))))
        .when(is_("(?i)^BEGIN:VCARD"), made("contacto", nombre=_plain(F.coalesce(F.nullif(_line(t, "FN"), F.lit("")), name(_line(t, "N"), ";"))), telefono=_line(t, "TEL"), correo=_line(t, "EMAIL")))
        .when(is_("(?i)^MECARD:"), made("contacto", nombre=name(field(me, "N"), ","), telefono=field(me, "TEL"), correo=field(me, "EMAIL")))
        .otherwise(made("texto"))
    )


def pin_format(pin: Column) -> Column:
    """Whether a PIN is four to twelve digits and nothing else; null is none."""
    return F.coalesce(F.rlike(pin, F.lit(r"\A[0-9]{4,12}\z")), F.lit(False))
