"""Configurations as rows: flattened documents, closed schemas, rules between fields; SQL functions by name."""

from __future__ import annotations

from quillstone.functions import sqlnames
from quillstone.operators import rules as R
from quillstone.plans import views as V
from quillstone.sources import variants

CATALOGUE: dict[str, tuple] = {}

#: Release names that the generated configurations may have as parents.
RL_PARENT, DPO_PARENT = "dpo-step000040", "sft-step000030"


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def _member(name: str, *cases: tuple[str, str], otherwise: str) -> str:
    """SQL text of a member whose value depends on the row's number k; an empty value leaves it out."""
    whens = " ".join(f"WHEN {c} THEN '\"{name}\":{v},'" if v else f"WHEN {c} THEN ''" for c, v in cases)
    rest = f"'\"{name}\":{otherwise},'" if otherwise else "''"
    return f"CASE {whens} ELSE {rest} END" if cases else rest


def _object(name: str | None, *members: str) -> str:
    """SQL text of an object; every member ends in a comma, so a last one closes the list."""
    head = f"'\"{name}\":{{'" if name else "'{'"
    return f"{head} || {' || '.join(members)} || '\"zz\":0}}{',' if name else ''}'"


#: Documents of an order's number k, as one expression that both engines read alike.
RL_DOC = _object(
    None, _member("profile", ("k % 7 = 0", '"smoke"'), ("k % 7 = 1", '"trial"'), otherwise='"pilot"'),
    _object("model", _member("parent_release", ("k % 17 = 0", '"other"'), otherwise=f'"{RL_PARENT}"')),
    _object("optim", _member("learning_rate", ("k % 3 = 0", "1e-06"), ("k % 11 = 0", "0.01"), otherwise="1e-05"), _member("scheduler_max_steps", ("k % 3 = 0 AND k % 5 < 4", "50"), ("k % 5 = 1", "null"), ("k % 23 = 0", "100"), otherwise="")),
    _object("lora", _member("dropout", ("k % 13 = 0", "0.1"), otherwise="0.0")),
    _object("batch", _member("micro_batch_size", otherwise="1"), _member("gradient_accumulation_steps", ("k % 3 = 0", "4"), otherwise="2")),
    _object("train", _member("max_steps", ("k % 3 = 0", "20"), ("k % 7 = 0", "6"), ("k % 19 = 0", ""), otherwise="50"), _member("max_epochs", ("k % 7 = 0", "100"), otherwise="1"), _member("save_steps", otherwise="5"), _member("eval_steps", ("k % 29 = 0", "6"), otherwise="5")),
    _object("runtime", _member("max_runtime_minutes", ("k % 7 = 0", "30"), otherwise="120")),
    _object(
        "rl", _member("train_scenarios", ("k % 3 = 0", R.DEGRADED), ("k % 31 = 0", R.NON_DROPOUT), otherwise="null"), _member("loss_token_scope", ("k % 3 = 0", '"mismatched_only"'), otherwise='"sequence"'),
        _member("max_edit_count", ("k % 3 = 0", "2"), otherwise="null"), _member("accumulate_signal_groups_only", ("k % 3 = 0 AND k % 37 > 0", "true"), otherwise="false"),
        _member("dropout_anchor_weight", ("k % 3 = 0", "0.05"), ("k % 2 = 0", "0.0"), otherwise=""), _member("kl_beta", ("k % 3 = 0", "0.10"), otherwise="0.04"), _member("updates_per_rollout", otherwise="1"),
        _member("max_group_visits", ("k % 3 = 0", "1000"), otherwise="500"), _member("no_signal_stop_groups", ("k % 3 = 0", "100"), otherwise="20"), _member("invalid_group_rate_max", otherwise="0.01"),
        _object("parent", _member("release_id", otherwise=f'"{RL_PARENT}"'), _member("source_step", ("k % 41 = 0", "30"), otherwise="40")),
    ),
)
DPO_DOC = _object(
    None, _member("profile", ("k % 4 = 0", '"dropout_probe"'), ("k % 4 = 1", '"smoke"'), otherwise='"pilot"'),
    _object("model", _member("parent_release", ("k % 17 = 0", '"other"'), otherwise=f'"{DPO_PARENT}"')),
    _object("optim", _member("learning_rate", ("k % 4 = 0", "5e-05"), ("k % 11 = 0", "0.01"), otherwise="5e-06"), _member("warmup_steps", ("k % 4 = 0", "0"), otherwise="10"), _member("scheduler_max_steps", ("k % 5 = 1", "100"), otherwise="")),
    _object("lora", _member("dropout", otherwise="0.0")),
    _object("batch", _member("micro_batch_size", otherwise="1"), _member("gradient_accumulation_steps", ("k % 13 = 0", "2"), otherwise="4")),
    _object("train", _member("max_steps", ("k % 4 = 0", "10"), ("k % 3 = 0", "40"), otherwise="100"), _member("max_epochs", otherwise="1"), _member("save_steps", otherwise="10"), _member("eval_steps", otherwise="10"), _member("keep_last", ("k % 19 = 0", "3"), otherwise="1")),
    _object("runtime", _member("max_runtime_minutes", otherwise="120")),
    _object(
        "dpo", _member("beta", otherwise="0.1"), _member("dropout_anchor_weight", ("k % 3 = 0", "0.05"), otherwise=""), _member("dropout_anchor_target", ("k % 6 < 4", '"rejected_text"'), otherwise="null"),
        _member("loss_token_scope", ("k % 9 < 7", '"mismatched_only"'), otherwise='"sequence"'), _member("train_scenarios", ("k % 4 = 0", '["dropout"]'), ("k % 7 = 0", R.NON_DROPOUT), ("k % 7 = 1", '["noise"]'), ("k % 7 = 2", R.DEGRADED), otherwise="null"),
        _member("val_scenarios", ("k % 31 = 0", '["noise"]'), otherwise="null"), _member("exclude_clean_identical_rejected", ("k % 7 < 3", "true"), otherwise="false"), _member("launch_utterance", ("k % 8 = 0", '"u1"'), otherwise="null"),
        *[_member(f"{n}_pairs_sha256", (f"k % {p} = 0", '"aa"'), otherwise=f'"{n}"') for n, p in (("null_train", 3), ("source_null_train", 2), ("null_val", 5), ("source_null_val", 7), ("filled_train", 9), ("filled_val", 25))],
        _object("parent", _member("release_id", otherwise=f'"{DPO_PARENT}"'), _member("source_step", ("k % 41 = 0", "40"), otherwise="30")),
    ),
)
DATA_DOC = _object(
    None, _member("schema_version", otherwise='"v1"'), _member("seed", ("k % 3 = 0", "4.5"), ("k % 5 = 0", '"x"'), otherwise="42"), _member("source_version", ("k % 7 = 0", ""), otherwise='"s"'), _member("audited", ("k % 11 = 0", "1"), otherwise="true"),
    _member("audio_processor_version", otherwise='"p"'), _member("language", ("k % 13 = 0", '"en"'), otherwise='"zh"'), _member("sample_rate", ("k % 17 = 0", "8000"), ("k % 17 = 1", "16000.0"), otherwise="16000"),
    _object("duration_seconds", _member("min", ("k % 19 = 0", "-1"), otherwise="0.5"), _member("max", ("k % 23 = 0", ""), otherwise="20")), _object("splits", _member("val", otherwise="0.1"), _member("test", ("k % 29 = 0", "1.5"), otherwise="0.1")),
    _member("quota", ("k % 31 = 0", "null"), ("k % 31 = 1", "7"), otherwise='{"min_val_rows_per_scenario":20}'), _member("scenarios", ("k % 37 = 0", "[]"), otherwise='["clean","noise","reverb","far_field","dropout"]'), _member("augmentation", otherwise="{}"),
)


def dealt(rows, key: str):
    """`rows` over all tasks: small in bytes and long in the parsing, they aren't left to the few tasks that read them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def documents(spark, sf_dir, doc: str):
    """A document of each order; the orders' keys alone are dealt out, documents are made in place."""
    return dealt(V.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id"), "id").selectExpr("id", "id AS k").selectExpr("id", f"{doc} AS doc")


def _docs(doc: str) -> str:
    return f"WITH docs AS (SELECT id, {doc} AS doc FROM (SELECT o_orderkey AS id, o_orderkey AS k FROM orders))"


@query(R.duck_violations(_docs(RL_DOC), R.rl_rules(RL_PARENT)))
def rl_config_violations(spark, sf_dir):
    return R.violations_in(documents(spark, sf_dir, RL_DOC), "id", "doc", R.rl_rules(RL_PARENT))


@query(R.duck_violations(_docs(DPO_DOC), R.dpo_rules(DPO_PARENT)))
def dpo_config_violations(spark, sf_dir):
    return R.violations_in(documents(spark, sf_dir, DPO_DOC), "id", "doc", R.dpo_rules(DPO_PARENT))


_TREE = """tree AS (SELECT docs.id, substr(j.fullkey, 3) AS path, j.type, j.value FROM docs, json_tree(docs.doc) j WHERE j.fullkey NOT LIKE '%[%' AND j.fullkey <> '$')"""
_SCHEMA = "schema(path, kinds, required, low, high, choices) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in R.DATA_SCHEMA
) + ")"


@query(f"""{_docs(DATA_DOC)}, {_TREE}, {_SCHEMA}, typed AS (SELECT *, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE type WHEN 'ARRAY' THEN value::VARCHAR WHEN 'VARCHAR' THEN value->>'$' ELSE value::VARCHAR END AS said FROM tree),
j AS (SELECT t.id, t.path, CASE WHEN s.path IS NULL THEN 'unknown'
    WHEN NOT (list_contains(string_split(kinds, '|'), kind) OR (list_contains(string_split(kinds, '|'), 'integer') AND kind = 'number' AND try_cast(said AS DOUBLE) = floor(try_cast(said AS DOUBLE)))) THEN 'kind'
    WHEN kind = 'number' AND (coalesce(try_cast(said AS DOUBLE) < low, false) OR coalesce(try_cast(said AS DOUBLE) > high, false)) THEN 'range'
    WHEN choices IS NOT NULL AND kind <> 'null' AND NOT list_contains(string_split(choices, '|'), said) THEN 'choice' END AS problem FROM typed t LEFT JOIN schema s USING (path)),
objects AS (SELECT id, '$' AS path FROM docs UNION ALL SELECT id, path FROM typed WHERE kind = 'object')
SELECT id, path, problem FROM j WHERE problem IS NOT NULL
UNION ALL SELECT o.id, s.path, 'missing' FROM objects o JOIN schema s ON o.path = CASE WHEN s.path LIKE '%.%' THEN regexp_replace(s.path, '\\.[^.]*$', '') ELSE '$' END AND s.required
  LEFT JOIN tree t ON t.id = o.id AND t.path = s.path WHERE t.path IS NULL""")
def data_config_problems(spark, sf_dir):
    """A closed schema over configurations; the generated ones end in an unknown member."""
    return variants.schema_problems_in(variants.folded(documents(spark, sf_dir, DATA_DOC), "id", "doc"), "id", R.DATA_SCHEMA)


@query("SELECT event_id, substr(j.fullkey, 3) AS path, j.value::VARCHAR AS value FROM events, json_tree(events.props) j WHERE j.fullkey <> '$'")
def config_leaves(spark, sf_dir):
    """The members of every event's properties."""
    found = variants.leaves(dealt(V.table(spark, sf_dir, "events").select("event_id", "props"), "event_id"), "event_id", "props")
    return found.where("path <> '$'").select("event_id", "path", "value")


@query(f"""WITH {V.SCORED} SELECT sample_id, r AS norm, levenshtein(r, p)::INT AS edits, greatest(0, length(r) - length(p))::INT <= levenshtein(r, p) AS bounded FROM normed""")
def sql_text_functions(spark, sf_dir):
    """Registered functions, called from SQL."""
    sqlnames.register(spark)
    V.samples(spark, sf_dir).createOrReplaceTempView("quillstone_samples")
    return spark.sql("""
        SELECT sample_id, norm, edits, greatest(0, length(norm) - length(said)) <= size(filter(steps, s -> s.op <> 'match')) AND size(filter(steps, s -> s.op <> 'match')) = edits AS bounded
        FROM (SELECT sample_id, norm, said, token_levenshtein(split(norm, ''), split(said, '')) AS edits, align_edits(norm, said) AS steps
              FROM (SELECT sample_id, zh_cer_norm(reference) AS norm, zh_cer_norm(prediction) AS said FROM quillstone_samples))""")


@query("""WITH t AS (SELECT conv_id, turn, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, i::INT AS idx, turn::DOUBLE AS xmin, (turn + 1)::DOUBLE AS xmax, text AS label FROM t""")
def sql_textgrid_intervals(spark, sf_dir):
    """Conversations written as TextGrids and read by the table function, in a lateral join."""
    sqlnames.register(spark)
    V.table(spark, sf_dir, "conversations").createOrReplaceTempView("quillstone_turns")
    return spark.sql(r"""
        WITH grids AS (
          SELECT conv_id, concat('File type = "ooTextFile"\nObject class = "TextGrid"\n0\n', max(turn) + 1, '\n<exists>\n1\n"IntervalTier"\n"turns"\n0\n', max(turn) + 1, '\n', count(*), '\n',
            array_join(transform(array_sort(collect_list(struct(turn, text))), x -> concat(x.turn, '\n', x.turn + 1, '\n"', replace(translate(x.text, '\n\r', '  '), '"', '""'), '"')), '\n')) AS grid
          FROM quillstone_turns GROUP BY conv_id)
        SELECT conv_id, i.idx, i.xmin, i.xmax, i.label FROM grids, LATERAL parse_textgrid(grid) i""")


@query(f"""WITH {V.SCORED} SELECT scenario, sum(levenshtein(r, p))::BIGINT AS steps, sum(greatest(0, length(r) - length(p)))::BIGINT AS fewer FROM normed GROUP BY scenario""")
def sql_edit_steps(spark, sf_dir):
    """Edits as rows of a table function: their number, and how many more deletions than insertions, by scenario."""
    sqlnames.register(spark)
    V.samples(spark, sf_dir).createOrReplaceTempView("quillstone_samples")
    return spark.sql("""
        SELECT scenario, sum(steps) AS steps, sum(greatest(0, fewer)) AS fewer FROM (
          SELECT sample_id, scenario, count_if(e.op <> 'match') AS steps, count_if(e.op = 'delete') - count_if(e.op = 'insert') AS fewer
          FROM (SELECT sample_id, scenario, zh_cer_norm(reference) AS r, zh_cer_norm(prediction) AS p FROM quillstone_samples), LATERAL edit_steps(r, p) e GROUP BY sample_id, scenario)
        GROUP BY scenario""")
