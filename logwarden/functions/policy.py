"""Risk policy as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.text import strip
from logwarden.schemas import AUTO_RISKS, RISKS

# Execution types, commands and result texts.
AUTO = "AUTO_EXECUTE"
GATE = "WEBHOOK_GATE"
COMMAND_PREFIX = "mock-remediation "
AUTO_COMMANDS = ((("cache", "redis"), "clear_cache"), (("restart",), "restart_daemon"))
AUTO_DEFAULT = "benign_routine"
GATE_COMMANDS = ((("scale",), "scale_up"), (("infrastructure", "db", "pool"), "modify_db_pool"))
GATE_DEFAULT = "complex_mitigation"
FEED_COMMANDS = ((("scale",), "scale_up"), (("db",), "modify_db_pool"))


def known_risk(risk: Column) -> Column:
    """Anything outside the vocabulary is treated as LOW."""
    return F.when(risk.isin(*RISKS), risk).otherwise(F.lit("LOW"))


def action_id(risk: Column) -> Column:
    return F.concat(F.lit("remediate-"), F.lower(known_risk(risk)))


def execution_type(risk: Column) -> Column:
    return F.when(known_risk(risk).isin(*AUTO_RISKS), F.lit(AUTO)).otherwise(F.lit(GATE))


def _first_match(text: Column, rules, default: str) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    chain = None
    for words, command in rules:
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        value = F.lit(COMMAND_PREFIX + command)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.lit(COMMAND_PREFIX + default))


def target_command(risk: Column, fix: Column) -> Column:
    return F.when(
        execution_type(risk) == AUTO, _first_match(fix, AUTO_COMMANDS, AUTO_DEFAULT)
    ).otherwise(_first_match(fix, GATE_COMMANDS, GATE_DEFAULT))


def feed_command(fix: Column) -> Column:
    """The live feed knows fewer gate rules than the policy and differs on purpose."""
    return _first_match(fix, FEED_COMMANDS, GATE_DEFAULT)


def action_result(command: Column) -> Column:
    """Struct (returncode, stdout, stderr) that a stand-in run of a command gives; nothing is executed."""
    words = F.split(strip(F.coalesce(command, F.lit(""))), r"\s+")
    first = F.get(words, 0)
    action = F.coalesce(F.get(words, 1), F.lit("benign"))
    empty = first == ""
    stdout = (
        F.when(empty, F.lit(""))
        .when(first == COMMAND_PREFIX.strip(), F.concat(F.lit("[MOCK_HEALING] Executed action: "), action))
        .otherwise(F.concat(F.lit("Custom command: "), F.array_join(words, " ")))
    )
    return F.struct(
        F.when(empty, F.lit(-1)).otherwise(F.lit(0)).alias("returncode"),
        stdout.alias("stdout"),
        F.when(empty, F.lit("Empty command")).otherwise(F.lit("")).alias("stderr"),
    )


def execution_status(result: Column) -> Column:
    return F.when(result["returncode"] == 0, F.lit("SUCCESS")).otherwise(F.lit("FAILED"))


def risk_badge(risk: Column) -> Column:
    return F.when(risk.isin(*RISKS), risk).otherwise(F.lit("OTHER"))


def risk_rank(risk: Column) -> Column:
    rank = F.lit(0)
    for position, name in enumerate(RISKS, start=1):
        rank = F.when(risk == name, F.lit(position)).otherwise(rank)
    return rank


def severity_class(level: Column) -> Column:
    return F.when(level.isin("ERROR", "CRITICAL", "WARNING"), level).otherwise(F.lit("OTHER"))
