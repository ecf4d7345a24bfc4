"""Rules over one open port.

The ``*_sql`` functions return SQL text. Their ``at`` prefix says where the port fields
are: empty for a flat ``port_obs`` row, ``p.`` for an element ``p`` of a nested array. The
other functions are columns over a flat row.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanfold.functions.sql_text import case, contains_any, numbers, quote, strings
from scanfold.values import ports as V
from scanfold.values import rules as R

# Whitespace as text splitting understands it, beyond the ASCII blanks.
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

GROUP_NAMES = list(V.PORT_GROUPS)
FLAG_NAMES = [flag for flag, _ in V.HOST_FLAGS]


def group_bit(group: str) -> int:
    return 1 << GROUP_NAMES.index(group)


def port_facts() -> list:
    """Per known port: profile fields, risk score, group bits and flag bits."""
    profiles = {row[0]: row for row in V.PORT_PROFILES}
    known = sorted(set(profiles).union(*V.PORT_GROUPS.values()))
    rows = []
    for port in known:
        _, name, category, risk, description, advice = profiles.get(port, (port, *[None] * 5))
        groups = sum(group_bit(g) for g, members in V.PORT_GROUPS.items() if port in members)
        flags = sum(1 << i for i, (_, members) in enumerate(V.HOST_FLAGS) if port in members)
        rows.append((port, name, category, risk, V.RISK_SCORES.get(risk), description, advice,
                     groups, flags))
    return rows


def service_sql(at: str = "") -> str:
    return f"lower(coalesce({at}service, ''))"


def bucket_sql(at: str = "") -> str:
    service = service_sql(at)
    return case([(contains_any(service, tokens), quote(bucket)) for bucket, tokens in V.SERVICE_BUCKETS],
                quote(V.OTHER_BUCKET))


def token_category_sql(at: str = "") -> str:
    """Category of the first known token in the service, null if none."""
    service = service_sql(at)
    return case([(f"contains({service}, {quote(t)})", quote(c)) for t, c in V.SERVICE_TOKENS])


def category_sql(profile_category: str, at: str = "") -> str:
    """Profile category; unprofiled ports take it from the service name."""
    return f"coalesce({profile_category}, {token_category_sql(at)}, {quote(V.UNPROFILED_CATEGORY)})"


def risk_sql(profile_score: str, at: str = "") -> str:
    """Profile score, at least ``high`` for a cleartext service name."""
    base = f"coalesce({profile_score}, {V.RISK_SCORES[V.UNPROFILED_RISK]})"
    raised = f"greatest({base}, {V.RISK_SCORES['high']})"
    return f"CASE WHEN contains({service_sql(at)}, {quote(V.CLEARTEXT_TOKEN)}) THEN {raised} ELSE {base} END"


def level_sql(score: str) -> str:
    return f"element_at(array({strings(V.RISK_SCORES)}), {score})"


def unknown_sql(at: str = "") -> str:
    """Trimmed, lower-cased service is empty or ``unknown``."""
    return f"trim({service_sql(at)}) IN ({strings(R.UNKNOWN_SERVICE_NAMES)})"


def lookup_sql(field: int, port: str, value=quote) -> str:
    """A fact of a port by its number, as a CASE over the distinct values."""
    by_value = {}
    for row in port_facts():
        if row[field]:
            by_value.setdefault(row[field], []).append(row[0])
    return case([(f"{port} IN ({numbers(ports)})", value(v)) for v, ports in by_value.items()])


# --- columns over a flat row -------------------------------------------------

def service_bucket() -> Column:
    """Bucket of the service name; the first matching bucket wins."""
    return F.expr(bucket_sql())


def port_category() -> Column:
    return F.expr(category_sql(lookup_sql(2, "port")))


def port_risk_score() -> Column:
    """Risk score 1-4 of a port."""
    return F.expr(risk_sql(lookup_sql(4, "port", str)))


def risk_level(score: str) -> Column:
    return F.expr(level_sql(score))


def is_unknown_service() -> Column:
    return F.expr(unknown_sql())


def has_enrichment() -> Column:
    """A second look or a guess has already been made for this port."""
    return F.expr(
        f"coalesce(service_source, '') = {quote(R.SOURCE_ENRICHED)} OR coalesce(service_guess, '') <> '' "
        "OR coalesce(device_guess, '') <> '' OR coalesce(guess_evidence, '') <> ''")


def default_service_source() -> Column:
    """The given source, or one derived from whether the service is known."""
    return F.expr(
        f"CASE WHEN coalesce(service_source, '') <> '' THEN service_source WHEN {unknown_sql()} "
        f"THEN {quote(R.SOURCE_GUESS)} ELSE {quote(R.SOURCE_SCAN)} END")


def script_summary(scripts: str = "scripts") -> Column:
    """The first scripts as ``id: output``, long outputs cut with an ellipsis.

    Only the start of a long output is cleaned: what it gives beyond the greatest length is cut off
    anyway. Where that start holds so many blanks that it gives less, the whole output is cleaned.
    """
    spaces = WHITESPACE.replace("\\", "\\\\")
    keep = R.SCRIPT_MAX_LENGTH
    head = keep + keep // 4

    def clean(text):
        return f"trim(regexp_replace({text}, '{spaces}', ' '))"
    return F.expr(f"""array_join(transform(transform(
        transform(slice({scripts}, 1, {R.SCRIPT_LIMIT}), s -> named_struct('id', s.id, 'output', s.output,
            'text', {clean(f"substring(coalesce(s.output, ''), 1, {head})")})),
        s -> named_struct('id', s.id, 'text', CASE WHEN length(s.text) > {keep} OR length(coalesce(s.output, '')) <= {head}
             THEN s.text ELSE {clean('s.output')} END)),
        s -> CASE WHEN s.text = '' THEN s.id WHEN length(s.text) > {keep}
             THEN concat(s.id, ': ', substring(s.text, 1, {keep - 3}), '...')
             ELSE concat(s.id, ': ', s.text) END), ' | ')""")


def script_text_sql(scripts: str = "scripts") -> str:
    return (f"lower(array_join(flatten(transform({scripts}, "
            "s -> array(coalesce(s.id, ''), coalesce(s.output, '')))), ' '))")


def script_text() -> Column:
    """All script ids and outputs, space-joined and lower-cased."""
    return F.expr(script_text_sql())


def product_version_sql(at: str = "") -> str:
    return f"trim(concat(coalesce({at}product, ''), ' ', coalesce({at}version, '')))"


def risky_port_list(score: str) -> Column:
    """Aggregate: high and critical ports of a group as ``port/level`` in record order."""
    return F.expr(f"""array_join(transform(array_sort(collect_list(CASE WHEN {score} >= {V.RISK_SCORES['high']}
        THEN named_struct('pos', pos, 't', concat(cast(port AS string), '/', {level_sql(score)})) END)),
        e -> e.t), ';')""")


def or_none(name: str) -> Column:
    return F.expr(f"CASE WHEN coalesce({name}, '') = '' THEN 'None' ELSE {name} END")
