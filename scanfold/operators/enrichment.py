"""Second look and guesses for ports without a service name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.functions import port_rules as P
from scanfold.functions.sql_text import case, contains_any, numbers, quote, strings
from scanfold.operators.baseline import MOST_BROADCAST_SCANS
from scanfold.operators.shuffle import latest, salted_join
from scanfold.sources.workspace import stored
from scanfold.values import ports as V
from scanfold.values import rules as R

KEYS = ["scan_id", "ip"]
PORT_KEY = ["scan_id", "ip", "protocol", "port"]
GUESS_TYPES = {"original_service": "string", "service_guess": "string", "device_guess": "string",
               "guess_confidence": "double", "guess_evidence": "string"}
REPLACED = ["service", "product", "version", "extrainfo", "service_method", "service_confidence",
            "service_ostype", "tunnel", "state_reason", "scripts"]


def with_guess_columns(port_obs: DataFrame) -> DataFrame:
    """Add the optional guess columns, empty, where they are absent."""
    present = set(port_obs.columns)
    return port_obs.withColumns({
        c: F.lit(None).cast(t) for c, t in GUESS_TYPES.items() if c not in present})


def set_default_sources(port_obs: DataFrame) -> DataFrame:
    return port_obs.withColumn("service_source", P.default_service_source())


def _open_question():
    return P.is_unknown_service() & ~P.has_enrichment()


def unknown_ports_by_host(port_obs: DataFrame, only_missing: bool = True) -> DataFrame:
    """Sorted distinct unknown ports per host."""
    wanted = _open_question() if only_missing else P.is_unknown_service()
    return (with_guess_columns(port_obs).filter(wanted & (F.col("ip") != ""))
            .groupBy(*KEYS).agg(F.sort_array(F.collect_set("port")).alias("ports")))


def needs_enrichment(port_obs: DataFrame) -> DataFrame:
    """Per scan, whether any unknown port has no enrichment yet."""
    return with_guess_columns(port_obs).groupBy("scan_id").agg(
        F.bool_or(_open_question()).alias("needs_enrichment"))


def enrichment_totals(port_obs: DataFrame) -> DataFrame:
    """Per scan, hosts and (host, port) pairs with open questions."""
    per_host = unknown_ports_by_host(port_obs).select("scan_id", F.size("ports").alias("n"))
    return per_host.groupBy("scan_id").agg(
        F.count("*").alias("unknown_hosts"), F.sum("n").alias("unknown_ports"))


def merge_second_pass(port_obs: DataFrame, second: DataFrame) -> DataFrame:
    """Take over ten fields from a second scan where it names the service."""
    first = with_guess_columns(port_obs)
    # A host's second looks come as one list, so ports move by host, as for what is joined to them next.
    looks = latest(second, PORT_KEY, F.col("pos")).groupBy(*KEYS).agg(
        F.collect_list(F.struct("protocol", "port", *REPLACED)).alias("_second"))
    mine = "try_element_at(filter(_second, s -> s.protocol = protocol AND s.port = port), 1)"
    known = F.coalesce(~F.trim(F.lower(F.coalesce(F.col("_found.service"), F.lit("")))).isin(
        R.UNKNOWN_SERVICE_NAMES), F.lit(False)) & F.col("_found").isNotNull()
    joined = first.join(looks, KEYS, "left").withColumn("_found", F.expr(mine))
    changes = {"original_service": F.when(
        known, F.coalesce("original_service", "service")).otherwise(F.col("original_service"))}
    for c in REPLACED:
        changes[c] = F.when(known, F.col(f"_found.{c}")).otherwise(F.col(c))
    changes["service_source"] = F.when(known, R.SOURCE_ENRICHED).otherwise(F.col("service_source"))
    for c in list(GUESS_TYPES)[1:]:
        changes[c] = F.when(known, F.lit(None).cast(GUESS_TYPES[c])).otherwise(F.col(c))
    return joined.withColumns(changes).select(*first.columns)


def host_context(port_obs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host, the four signals that guesses use.

    No token holds a blank, so a token found in the joined host text is found in one of
    its parts; each part is tested where it lies and only booleans are combined.
    """
    lowered = port_obs.selectExpr(*KEYS, "port", *[f"{sql} AS {name}" for name, sql in _texts().items()])
    by_port = lowered.groupBy(*KEYS).agg(*[F.expr(f"bool_or({sql})").alias(name) for name, sql in _port_tests().items()])
    joined = hosts.selectExpr(*KEYS, HOST_WORDS).join(by_port, KEYS, "left")
    return joined.selectExpr(*KEYS, *[f"{sql} AS {name}" for name, sql in _host_signals().items()])


FIELDS = ["f_service", "f_product", "f_version", "f_extrainfo", "f_scripts"]
HOST_WORDS = ("lower(concat_ws(' ', coalesce(hostname, ''), coalesce(vendor, ''), "
              "transform(os_matches, m -> m.name))) AS words")


def _texts() -> dict:
    """SQL text of the texts of a port that tokens are looked for in."""
    return {f: f"lower(coalesce({f[2:]}, ''))" for f in FIELDS[:4]} | {"f_scripts": P.script_text_sql()}


def _port_tests() -> dict:
    """SQL text of what one port says of its host, over its texts."""
    def any_token(tokens):
        return " OR ".join(contains_any(text, tokens) for text in FIELDS)
    return {
        "apple_port": f"{any_token(R.APPLE_TOKENS)} OR port IN ({numbers(R.APPLE_PORTS)}) OR f_service IN ({strings(R.APPLE_SERVICES)})",
        "media_port": any_token(R.MEDIA_TOKENS),
        "printer_port": f"{any_token(R.PRINTER_TOKENS)} OR port IN ({numbers(R.PRINTER_PORTS)})",
        "web_port": f"port IN ({numbers(V.PORT_GROUPS['web'])})"}


def _host_signals() -> dict:
    """SQL text of the four signals, from a host's words and its port signals."""
    def signal(tokens, port_signal):
        return f"{contains_any('words', tokens)} OR coalesce({port_signal}, false)"
    return {"has_apple": signal(R.APPLE_TOKENS, "apple_port"), "has_media": signal(R.MEDIA_TOKENS, "media_port"),
            "has_printer_sign": signal(R.PRINTER_TOKENS, "printer_port"), "has_web_admin": "coalesce(web_port, false)"}


def _with_host_context(port_obs: DataFrame, hosts: DataFrame) -> DataFrame:
    """``port_obs`` left-joined with its ``host_context``. A window over the host combines what its
    ports say, so they are neither computed nor moved a second time."""
    from pyspark.sql import Window as W
    host = W.partitionBy(*KEYS)
    tests = _port_tests()
    rows = port_obs.selectExpr("*", *[f"{sql} AS {f}" for f, sql in _texts().items()])
    rows = rows.selectExpr(*port_obs.columns, *[f"{sql} AS {name}" for name, sql in tests.items()])
    rows = rows.withColumns({name: F.bool_or(name).over(host) for name in tests})
    joined = rows.join(hosts.selectExpr(*KEYS, HOST_WORDS), KEYS, "left")
    # Without a host row there are no words, and no signal either.
    return joined.selectExpr(*port_obs.columns, *[
        f"CASE WHEN words IS NOT NULL THEN {sql} END AS {name}" for name, sql in _host_signals().items()])


def _guess_columns() -> dict:
    """SQL text of the guessed columns, from the port and the host signals."""
    ephemeral = f"port >= {V.EPHEMERAL_PORT_MIN}"
    media_port = f"port IN ({numbers(V.PORT_GROUPS['media'])})"
    only_media = "has_media AND NOT has_apple"
    only_printer = "has_printer_sign AND NOT has_apple AND NOT has_media"
    only_web = "has_web_admin AND NOT (has_apple OR has_media OR has_printer_sign)"
    s, d, e = ({name: quote(text) for name, text in values.items()} for values in (
        R.GUESS_SERVICE, R.GUESS_DEVICE, R.GUESS_EVIDENCE))
    k = R.GUESS_CONFIDENCE
    service = case([
        (f"has_apple AND {ephemeral}", s["apple_dynamic"]), ("has_apple AND has_media", s["apple_media"]),
        (f"{only_media} AND {media_port}", s["media_port"]),
        (f"{only_media} AND {ephemeral}", s["media_dynamic"]),
        (f"{only_printer} AND port >= {V.UNCOMMON_PORT_MIN}", s["printer"]),
        (ephemeral, s["ephemeral"])], s["none"])
    device = case([("has_apple", d["apple"]), ("has_media", d["media"]), ("has_printer_sign", d["printer"]),
                   ("has_web_admin", d["web_admin"])], d["none"])
    steps = [
        (ephemeral, k["ephemeral"]), (f"has_apple AND {ephemeral}", k["apple_dynamic"]),
        (f"has_apple AND NOT {ephemeral} AND has_media", k["apple_media"]),
        (f"{only_media} AND {media_port}", k["media_port"]),
        (f"{only_media} AND NOT {media_port} AND {ephemeral}", k["media_dynamic"]),
        (only_printer, k["printer"]), (only_web, k["web_admin"])]
    confidence = f"greatest({k['none']}D, " + ", ".join(
        f"CASE WHEN {cond} THEN {value}D ELSE 0D END" for cond, value in steps) + ")"
    texts = [(ephemeral, e["ephemeral"]), ("has_apple", e["apple"]), (only_media, e["media"]),
             (only_printer, e["printer"]), (only_web, e["web_admin"])]
    evidence = "concat_ws('; ', " + ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in texts) + ")"
    return {
        "service_source": quote(R.SOURCE_GUESS), "service_guess": service, "device_guess": device,
        "guess_confidence": f"round(least({confidence}, {k['max']}D), 2)",
        "guess_evidence": f"coalesce(nullif({evidence}, ''), {e['none']})",
    }


def _with_guesses(rows: DataFrame, when: str) -> DataFrame:
    return rows.withColumns({c: F.expr(f"CASE WHEN {when} THEN {v} ELSE {c} END")
                             for c, v in _guess_columns().items()})


def guess_unknown_ports(port_obs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Guesses for the unknown ports only, one row per unknown port."""
    context = host_context(port_obs, hosts)
    unknown = with_guess_columns(port_obs).filter(P.is_unknown_service())
    return _with_guesses(unknown.join(context, KEYS, "left"), "true").drop(
        "has_apple", "has_media", "has_printer_sign", "has_web_admin")


def apply_guesses(port_obs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Whole table with default sources, and guesses on its unknown ports."""
    base = set_default_sources(with_guess_columns(port_obs))
    joined = base.join(host_context(base, hosts), KEYS, "left")
    return _with_guesses(joined, P.unknown_sql()).select(*base.columns)


def enrich_unknown_ports(port_obs: DataFrame, hosts: DataFrame,
                         second: DataFrame | None = None) -> DataFrame:
    """Default sources, optional second pass, then guesses where a question is open.

    A scan without an open question keeps its rows as they are.
    """
    base = with_guess_columns(set_default_sources(port_obs))
    gate = stored(needs_enrichment(base), "enrichment-gate")
    merged = merge_second_pass(base, second) if second is not None else base
    if gate.count() <= MOST_BROADCAST_SCANS:
        gated = merged.join(F.broadcast(gate), "scan_id", "left")
    else:
        gated = salted_join(merged, gate, ["scan_id"], ["ip", "port"])
    # After a second pass the ports lie by host already; else a small context needs no move of them.
    joined = gated.join(host_context(base, hosts), KEYS, "left") if second is None else _with_host_context(gated, hosts)
    return _with_guesses(joined, f"needs_enrichment AND {P.unknown_sql()}").select(*base.columns)


# --- the same within nested host records ----------------------------------------

def _ports_sql(fields: list, values: dict, at: str = "p") -> str:
    """A port of the given fields as SQL text, where ``values`` says which differ from ``at``."""
    return "named_struct(" + ", ".join(f"'{f}', {values.get(f, f'{at}.{f}')}" for f in fields) + ")"


def _fields(records: DataFrame) -> list:
    present = records.schema["open_ports"].dataType.elementType.fieldNames()
    return present + [c for c in GUESS_TYPES if c not in present]


def _base_ports(records: DataFrame) -> str:
    """SQL text of the ports with a source and with the guess fields, empty where they are absent."""
    present = set(records.schema["open_ports"].dataType.elementType.fieldNames())
    values = {c: f"cast(NULL AS {kind})" for c, kind in GUESS_TYPES.items() if c not in present}
    values["service_source"] = (f"CASE WHEN coalesce(p.service_source, '') <> '' THEN p.service_source WHEN {P.unknown_sql('p.')} "
                                f"THEN {quote(R.SOURCE_GUESS)} ELSE {quote(R.SOURCE_SCAN)} END")
    return f"transform(open_ports, p -> {_ports_sql(_fields(records), values)})"


def _open_questions() -> str:
    return (f"exists(open_ports, p -> {P.unknown_sql('p.')} AND NOT (p.service_source = {quote(R.SOURCE_ENRICHED)} OR coalesce(p.service_guess, '') <> '' "
            "OR coalesce(p.device_guess, '') <> '' OR coalesce(p.guess_evidence, '') <> ''))")


def _taken_over(records: DataFrame) -> str:
    """SQL text of the ports with the fields of the last second look, where that names the service."""
    looked = ("transform(open_ports, p -> named_struct('p', p, 'f', "
              "try_element_at(filter(_second, s -> s.protocol = p.protocol AND s.port = p.port), -1)))")
    known = f"x.f IS NOT NULL AND NOT {P.unknown_sql('x.f.')}"
    values = {c: f"CASE WHEN {known} THEN x.f.{c} ELSE x.p.{c} END" for c in REPLACED}
    values |= {c: f"CASE WHEN {known} THEN NULL ELSE x.p.{c} END" for c in list(GUESS_TYPES)[1:]}
    values["original_service"] = f"CASE WHEN {known} THEN coalesce(x.p.original_service, x.p.service) ELSE x.p.original_service END"
    values["service_source"] = f"CASE WHEN {known} THEN {quote(R.SOURCE_ENRICHED)} ELSE x.p.service_source END"
    return f"CASE WHEN _second IS NULL THEN open_ports ELSE transform({looked}, x -> {_ports_sql(_fields(records), values, 'x.p')}) END"


def _signals() -> dict:
    """SQL text of the four signals of a host row, from its words and its ports."""
    texts = [f"lower(coalesce(p.{f}, ''))" for f in ("service", "product", "version", "extrainfo")] + [P.script_text_sql("p.scripts")]

    def signal(tokens, more=""):
        return f"{contains_any('words', tokens)} OR exists(open_ports, p -> {' OR '.join(contains_any(t, tokens) for t in texts)}{more})"
    apple = f" OR p.port IN ({numbers(R.APPLE_PORTS)}) OR {texts[0]} IN ({strings(R.APPLE_SERVICES)})"
    return {"has_apple": signal(R.APPLE_TOKENS, apple), "has_media": signal(R.MEDIA_TOKENS),
            "has_printer_sign": signal(R.PRINTER_TOKENS, f" OR p.port IN ({numbers(R.PRINTER_PORTS)})"),
            "has_web_admin": f"exists(open_ports, p -> p.port IN ({numbers(V.PORT_GROUPS['web'])}))"}


def enrich_records(records: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """``enrich_unknown_ports`` within nested host records: ports never leave their row. The
    result is written, so that no expression over all ports is repeated by what reads single fields.

    Only the rows of the second pass are grouped, and one join on the host brings them to the
    records. Whether a scan has an open question is one row per scan, which is written and
    broadcast while there are at most ``MOST_BROADCAST_SCANS``.
    """
    base = records.withColumn("open_ports", F.expr(_base_ports(records)))
    gate = stored(base.groupBy("scan_id").agg(F.expr(f"bool_or({_open_questions()})").alias("needs_enrichment")), "enrichment-gate")
    rows = base
    if second is not None:
        looks = latest(second, PORT_KEY, F.col("pos")).groupBy(*KEYS).agg(
            F.collect_list(F.struct("protocol", "port", *REPLACED)).alias("_second"))
        rows = base.join(looks, KEYS, "left").withColumn("open_ports", F.expr(_taken_over(base))).drop("_second")
    if gate.count() <= MOST_BROADCAST_SCANS:
        rows = rows.join(F.broadcast(gate), "scan_id", "left")
    else:
        rows = salted_join(rows, gate, ["scan_id"], ["ip"])
    words = "lower(concat_ws(' ', coalesce(hostname, ''), coalesce(vendor, ''), transform(os_matches, m -> m.name)))"
    rows = rows.withColumn("words", F.expr(words)).withColumns({name: F.expr(sql) for name, sql in _signals().items()})
    guesses = ", ".join(f"'{c}', {sql}" for c, sql in _guess_columns().items())
    rows = rows.withColumn("_guesses", F.expr(f"transform(open_ports.port, port -> named_struct({guesses}))"))
    asked = f"coalesce(needs_enrichment, false) AND {P.unknown_sql('p.')}"
    values = {c: f"CASE WHEN {asked} THEN _guesses[i].{c} ELSE p.{c} END" for c in _guess_columns()}
    rows = rows.withColumn("open_ports", F.expr(f"transform(open_ports, (p, i) -> {_ports_sql(_fields(base), values)})"))
    return stored(rows.select(*records.columns), "enriched")
