"""Chat formatting with DataFrame functions only: a finite-state machine over roles and a declarative template."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn: head + role name + colon, the escaped text, and end. Texts of `loss_roles` carry loss."""

    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple = ("assistant",)
    #: state -> role -> next state; a conversation is valid if no step is missing and it ends in `final`
    steps: dict = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple = ("answered",)


def escape(text: Column) -> Column:
    """A backslash before each backslash, and one inside each `</turn>` and `###`: no mark is left in a text, and unescape() gives it back."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    out = F.regexp_replace(out, "<(?=/turn>)", r"<\\")
    return F.regexp_replace(out, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _named(role: Column, t: Template) -> Column:
    """A known role's name; any other role keeps its own spelling behind a question mark, with a backslash between colon and blank."""
    out = F.concat(F.lit("?"), F.regexp_replace(escape(role), ":(?= )", r":\\"))
    for r, name in t.names.items():
        out = F.when(role == r, F.lit(name)).otherwise(out)
    return out


def _role_of(name: Column, t: Template) -> Column:
    out = unescape(F.substring(name, F.lit(2), F.length(name)))
    for r, n in t.names.items():
        out = F.when(name == n, F.lit(r)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conv_id: formatted, segments (text, loss), loss_spans (start, length in code points), n_turns, valid.

    Rows of a conversation are ordered by turn, nulls first, then role and text, so ties are
    settled alike each time; repeated rows stay. A null text is empty, a null role is an empty
    role. Rows with a null conv_id form one conversation. Other columns are ignored. valid says
    whether the state machine accepts the roles; nothing is dropped for being invalid. A conversation is one row, so it
    must fit in a task, as its formatted text must. An empty table gives no rows.
    """
    t = template
    clean = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    loss = F.col("role").isin(*t.loss_roles)
    clean = clean.withColumn("opened", F.concat(F.lit(t.head), _named(F.col("role"), t), F.lit(t.colon)))
    clean = clean.withColumn("body", escape(F.col("text"))).withColumn("loss", loss)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "opened", "body", "loss")))
    chats = clean.groupBy("conv_id").agg(turns.alias("t"))
    pairs = [F.concat(F.lit(s + ">"), F.lit(r)) for s, m in t.steps.items() for r in m]
    nexts = [F.lit(n) for m in t.steps.values() for n in m.values()]
    table = F.map_from_arrays(F.array(*pairs), F.array(*nexts))
    state = F.aggregate("t", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), x["role"])), F.lit("error")))
    segments = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                F.struct(x["opened"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    at = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["text"])).alias("at"),
            F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(s["text"]).cast("long").alias("length")))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return (
        chats.select("conv_id", segments.alias("segments"), F.size("t").cast("long").alias("n_turns"), state.isin(*t.final).alias("valid"))
        .withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))
        .withColumn("loss_spans", at["spans"])
    )


def read_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Read `formatted` and `loss_spans` back: turns (role, text) and loss_text."""
    t = template
    pieces = F.filter(F.split("formatted", F.lit("\\Q" + t.end + "\\E"), -1), lambda p: p != "")
    sep = F.lit(t.colon)
    turn = lambda p: F.struct(
        _role_of(F.substring(p, F.lit(len(t.head) + 1), F.instr(p, t.colon) - 1 - len(t.head)), t).alias("role"),
        unescape(F.substring(p, F.instr(p, t.colon) + F.length(sep), F.length(p))).alias("text"),
    )
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", loss)


PROBE = "\\### Assistant: </turn> ok"


def op9(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    back = read_chats(format_chats(rows.unionByName(probe)))
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP9_SQL = r"""
WITH r AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, length(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'))
    + (SELECT count(*) FROM range(1, length(text) - 1) t(i) WHERE contains(text, '###') AND substr(text, i::BIGINT, 3) = '###') AS body_len,
  CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 6 WHEN 'assistant' THEN 9
    ELSE 1 + length(replace(replace(role, '\', '\\'), ': ', ':\ ')) END AS name_len FROM r),
a AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(4 + name_len + 2 + body_len + 8)::BIGINT AS formatted_chars,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid FROM a
"""
