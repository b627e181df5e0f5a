"""Column functions on names, paths, types and call expressions. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def one_of(x, allowed: Iterable[str]) -> Column:
    """The value if it is allowed, else null."""
    return F.when(_c(x).isin(*allowed), _c(x))


def only(array, allowed: Iterable[str]) -> Column:
    """The allowed elements, in order; null counts as no element."""
    allowed = list(allowed)
    return F.filter(F.coalesce(_c(array), F.array().cast("array<string>")), lambda v: v.isin(*allowed))


def none_if_empty(array) -> Column:
    return F.when(F.size(_c(array)) > 0, _c(array))


def first_in(array, allowed: Iterable[str]) -> Column:
    """The first allowed element in array order, or null."""
    allowed = list(allowed)
    return F.get(F.filter(_c(array), lambda v: v.isin(*allowed)), 0)


def blank_to_null(x) -> Column:
    return F.nullif(_c(x), F.lit(""))


def strip(x) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def after_last(x, mark: str = ".") -> Column:
    """Text after the last mark; all of it when there is none."""
    return F.substring_index(_c(x), mark, -1)


def callee(expr) -> Column:
    """Who a call is made on: null for a call on the object itself. Of a chain, the first link counts."""
    head = F.regexp_replace(F.substring_index(_c(expr), "(", 1), r"^this\.", "")
    return F.when(F.instr(head, ".") > 0, strip(F.regexp_replace(head, r"(?s)\.[^.]*$", "")))


def called_method(expr) -> Column:
    """Name of the method that a call names first."""
    head = F.regexp_replace(F.substring_index(_c(expr), "(", 1), r"^this\.", "")
    return strip(after_last(head))


def starts_upper(x) -> Column:
    return _c(x).rlike(r"^\p{Lu}")


def element_type(declared) -> Column:
    """What a List, Set, Collection or Optional holds, outermost only; other types as they are."""
    return F.regexp_replace(_c(declared), r"(?s)^(?:List|Set|Collection|Optional)<(.*)>$", "$1")


def without_generics(declared) -> Column:
    return F.trim(F.substring_index(_c(declared), "<", 1))


def package_of(fqcn) -> Column:
    return F.when(F.instr(_c(fqcn), ".") > 0, F.regexp_replace(_c(fqcn), r"(?s)\.[^.]*$", "")).otherwise("")


def group_after(package, prefix_length) -> Column:
    """First segment after a prefix of that many characters, or misc."""
    rest = F.regexp_replace(F.substr(_c(package), _c(prefix_length) + 1), r"^\.+", "")
    return F.coalesce(blank_to_null(F.substring_index(rest, ".", 1)), F.lit("misc"))


def kebab(name) -> Column:
    parts = F.regexp_replace(_c(name), "(?<=[0-9a-z])(?=[A-Z])", "-")
    return F.lower(F.regexp_replace(parts, "(?<=[A-Z])(?=[A-Z][a-z])", "-"))


def pascal(name) -> Column:
    parts = F.split(F.replace(_c(name), F.lit("-"), F.lit("_")), "_")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


_SUFFIX = {k: f".{v}.ts" for k, v in (("Controller", "controller"), ("ControllerAdvice", "filter"), ("Entity", "entity"), ("Repository", "repository"), ("RestController", "controller"), ("Service", "service"))}


def role_suffix(stereotype) -> Column:
    out = F.lit(".ts")
    for name, suffix in _SUFFIX.items():
        out = F.when(_c(stereotype) == name, suffix).otherwise(out)
    return out


def unquoted(x) -> Column:
    return F.regexp_replace(_c(x), '^"|"$', "")


def method_id(fqcn, name, types) -> Column:
    return F.concat(_c(fqcn), F.lit("#"), _c(name), F.lit("("), F.array_join(_c(types), ","), F.lit(")"))


def input_kind(spec) -> Column:
    low = F.lower(F.trim(_c(spec)))
    return F.when(low.endswith(".zip"), "zip").when(low.rlike(r"^(https?://|git@|git://)"), "git").otherwise("local")


def last_lines(x, n: int) -> Column:
    lines = F.split(_c(x), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n, F.lit(0)) + 1, F.lit(n)), "\n")


def line_slice(text, begin, end) -> Column:
    """Lines begin to end, from 1; all of the text when there is no such range or nothing in it.

    Lines end as Python's splitlines has it, form feeds and the like included.
    """
    lines = F.split(_c(text), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    begin, end = _c(begin), _c(end)
    part = F.array_join(F.slice(lines, F.greatest(begin, F.lit(1)), F.greatest(end - F.greatest(begin, F.lit(1)) + 1, F.lit(0))), "\n")
    usable = begin.isNotNull() & end.isNotNull() & ~((begin == 0) & (end == 0))
    return F.when(usable, F.coalesce(blank_to_null(part), _c(text))).otherwise(_c(text))


def domain_dir(path) -> Column:
    """Directory right under src of a generated file, or null."""
    parts = F.split(_c(path), "/")
    return F.when((F.get(parts, 0) == "src") & (F.size(parts) > 2), F.get(parts, 1))


def relative_path(path, base) -> Column:
    """POSIX path under a base; as given when it isn't under it."""
    full, base = F.replace(_c(path), F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(_c(base), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.startswith(full, F.concat(base, F.lit("/"))), F.substr(full, F.length(base) + 2)).otherwise(full)


def log_area(context, logger) -> Column:
    """Area of a log record: of its context, else the last part of the logger's name."""
    return F.coalesce(F.try_element_at(_c(context), F.lit("area")), after_last(logger))


_LABELS = {
    "anthropic": ["api.anthropic.com"], "deepseek": ["api.deepseek.com"], "google": ["generativelanguage.googleapis.com"], "minimax": ["api.minimax.chat", "api.minimaxi.com"], "mistral": ["api.mistral.ai"],
    "moonshot": ["api.moonshot.cn"], "openai": ["api.openai.com"], "openrouter": ["openrouter.ai"], "z.ai": ["open.bigmodel.cn"],
}
_HOSTS = {host: label for label, hosts in _LABELS.items() for host in hosts}


def provider_label(explicit, url, hosts: dict[str, str] | None = None) -> Column:
    """Given label, else the alias of the URL's host, else the host."""
    host = F.lower(F.parse_url(_c(url), F.lit("HOST")))
    names = F.create_map(*(F.lit(x) for pair in (hosts or _HOSTS).items() for x in pair))
    return F.coalesce(blank_to_null(explicit), F.try_element_at(names, host), host)


def class_summary(name, stereotype, annotations, superclass, interfaces, methods) -> Column:
    """Text block that describes a class to a code generator."""
    listed = lambda array, other: F.coalesce(blank_to_null(F.array_join(_c(array), ", ")), F.lit(other))
    facts = {"Resolved role": F.coalesce(blank_to_null(stereotype), F.lit("unknown")), "Class name": _c(name), "Top-level annotations": listed(annotations, "none"), "Superclass": F.coalesce(blank_to_null(superclass), F.lit("null")), "Interfaces": listed(interfaces, "null"), "Method count": F.coalesce(_c(methods), F.lit(0)).cast("string")}
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in facts.items()))
