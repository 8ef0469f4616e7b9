"""Rule packs: checked JSON that is compiled to column expressions.

A pack names banks with sender patterns and, for each, rules by priority. The first rule whose gate
matches decides, and a failure after that does not fall through to the next. A pack with any error
is refused as a whole.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import currency_code, parse_amount
from ..functions.text import TRANSFORMS, apply_transforms, mask_last4, sms_date

SCHEMA_VERSION = 1
#: A quantified group whose body ends in a quantifier: it can take exponential time.
NESTED_QUANTIFIER = re.compile(r"\([^)]*[+*]\s*\)\s*[+*]|\([^)]*\{\d+,\}[^)]*\)\s*[+*{]")
MONEY_FIELDS = {"amount": "currency", "convertedAmount": "convertedCurrency", "fee": "feeCurrency", "remainingBalance": "balanceCurrency"}
TEXT_FIELDS = ("merchant", "counterpartyName", "counterpartyBankName", "referenceNumber", "instrumentRef", "instrumentRefNetwork", "instrumentRefType", "settlementRef", "exchangeRate", "billerCode", "invoiceNumber")
TIMEZONES = {"Asia/Riyadh": 3, "UTC": 0}


class PackError(ValueError):
    """Why a pack is refused."""


def java_pattern(pattern: str) -> str:
    """Case-insensitive, Unicode-aware form of a pack's pattern."""
    if NESTED_QUANTIFIER.search(pattern):
        raise PackError(f"nested quantifier: {pattern}")
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except re.error as e:
        raise PackError(f"bad pattern {pattern}: {e}") from None
    return "(?iu)" + pattern


def group_numbers(pattern: str) -> dict[str, int]:
    """Number of each named group, counting plain groups too."""
    out, n = {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<(?P<name>[A-Za-z]\w*)>", pattern):
        if m[0][0] == "(":
            n += 1
            if m["name"]:
                out[m["name"]] = n
    return out


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: int
    message_type: str
    intent: str
    any_of: tuple[str, ...]
    all_of: tuple[str, ...]
    none_of: tuple[str, ...]
    regex: str | None
    groups: dict[str, int]
    extract: dict[str, dict]
    sign: str | None
    affects_spend: bool | None
    required: tuple[str, ...]
    redact: tuple[str, ...]


@dataclass(frozen=True)
class Bank:
    bank_id: str
    names: dict[str, str]
    aliases: tuple[str, ...]
    senders: tuple[str, ...]
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class RulePack:
    pack_id: str
    version: str
    banks: tuple[Bank, ...]


def _field(name: str, spec: dict, groups: dict[str, int]) -> dict:
    if "literal" not in spec and spec.get("group") not in groups:
        raise PackError(f"{name}: no group {spec.get('group')}")
    transform = spec.get("transform", [])
    for t in [transform] if isinstance(transform, str) else transform:
        if t not in TRANSFORMS:
            raise PackError(f"{name}: unknown transform {t}")
    if spec.get("maskPolicy", "last4") != "last4":
        raise PackError(f"{name}: unknown mask {spec['maskPolicy']}")
    if spec.get("timezone", "UTC") not in TIMEZONES:
        raise PackError(f"{name}: unknown time zone {spec['timezone']}")
    return spec | {"transform": [transform] if isinstance(transform, str) else transform}


def _rule(spec: dict) -> Rule:
    gate = spec.get("match", {})
    if spec["intent"] not in ("transaction", "ignore"):
        raise PackError(f"unknown intent {spec['intent']}")
    regex = spec.get("regex")
    groups = group_numbers(regex) if regex else {}
    if regex:
        java_pattern(regex)
    patterns = lambda key: tuple(java_pattern(p) for p in gate.get(key, []))
    for p in spec.get("redact", []):
        java_pattern(p)
    return Rule(
        spec["ruleId"], int(spec["priority"]), spec["messageType"], spec["intent"], patterns("anyOf"), patterns("allOf"), patterns("noneOf"),
        regex, groups, {k: _field(k, v, groups) for k, v in spec.get("extract", {}).items()}, spec.get("sign"), spec.get("affectsSpend"),
        tuple(spec.get("requiredFields", [])), tuple(spec.get("redact", [])),
    )


def load_pack(text: str) -> RulePack:
    """Parses and checks a pack; rules are put in order of priority, then of declaration."""
    try:
        pack = json.loads(text)
        if not 1 <= pack["schemaVersion"] <= SCHEMA_VERSION:
            raise PackError(f"schema version {pack['schemaVersion']}")
        if not pack["banks"]:
            raise PackError("no banks")
        banks = []
        for b in pack["banks"]:
            rules = sorted(map(_rule, b["messageRules"]), key=lambda r: -r.priority)
            banks.append(Bank(b["bankId"], b["displayName"], tuple(b.get("aliases", [])), tuple(java_pattern(p) for p in b["senderPatterns"]), tuple(rules)))
        return RulePack(pack["packId"], pack["packVersion"], tuple(banks))
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise PackError(f"malformed pack: {e!r}") from None


def rules_table(spark, pack: RulePack) -> DataFrame:
    """(bank_id, place, rule_id, priority, message_type, intent): the rules in the order in which they are tried."""
    rows = [(b.bank_id, i, r.rule_id, r.priority, r.message_type, r.intent) for b in pack.banks for i, r in enumerate(b.rules)]
    return spark.createDataFrame(rows, "bank_id string, place int, rule_id string, priority int, message_type string, intent string")


def profiles(spark, pack: RulePack) -> DataFrame:
    """(canonical_key, name_en, name_ar, aliases) of the pack's banks; a name that is missing is the key."""
    rows = [(b.bank_id, b.names.get("en", b.bank_id), b.names.get("ar", b.bank_id), list(b.aliases)) for b in pack.banks]
    return spark.createDataFrame(rows, "canonical_key string, name_en string, name_ar string, aliases array<string>")


def _first(branches: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for test, value in reversed(branches):
        out = F.when(test, value).otherwise(out)
    return out


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def bank_of(pack: RulePack, sender: Column) -> Column:
    """The first bank, in the pack's order, one of whose patterns the sender matches."""
    return _first([(_any(sender, b.senders), F.lit(b.bank_id)) for b in pack.banks], F.lit(None).cast("string"))


def redactions(pack: RulePack) -> dict[str, tuple[str, ...]]:
    """Patterns of secrets by bank, of all its rules, in Python's syntax; banks without any are left out."""
    plain = lambda p: re.sub(r"\(\?<(?![=!])", "(?P<", p)
    found = {b.bank_id: tuple(plain(p) for r in b.rules for p in r.redact) for b in pack.banks}
    return {bank: patterns for bank, patterns in found.items() if patterns}


def gate(rule: Rule, body: Column) -> Column:
    ok = _any(body, rule.any_of) if rule.any_of else F.lit(True)
    for p in rule.all_of:
        ok = ok & body.rlike(p)
    return ok & ~_any(body, rule.none_of)


def _value(rule: Rule, name: str, body: Column) -> Column:
    spec = rule.extract.get(name)
    if spec is None:
        return F.lit(None).cast("string")
    raw = F.lit(spec["literal"]) if "literal" in spec else F.regexp_extract(body, java_pattern(rule.regex), rule.groups[spec["group"]])
    raw = apply_transforms(raw, spec["transform"])
    if spec.get("maskPolicy"):
        raw = mask_last4(raw)
    return F.nullif(F.trim(raw), F.lit(""))


def _extraction(rule: Rule, body: Column) -> Column:
    fields = {}
    currency = currency_code(_value(rule, "currency", body))
    for money, code in MONEY_FIELDS.items():
        own = currency if code == "currency" else F.coalesce(currency_code(_value(rule, code, body)), currency)
        amount = parse_amount(_value(rule, money, body))
        fields[money] = F.when(own.isNotNull(), amount)
        fields[code] = F.when(fields[money].isNotNull(), own)
    for name in TEXT_FIELDS:
        fields[name] = _value(rule, name, body)
    when = rule.extract.get("occurredAt", {})
    at = sms_date(_value(rule, "occurredAt", body), when.get("format", "yyyy-MM-dd HH:mm:ss")) if when else F.lit(None).cast("timestamp")
    fields["occurredAt"] = at - F.expr(f"INTERVAL '{TIMEZONES[when.get('timezone', 'UTC')]}' HOUR") if when else at
    kinds = {name: F.when(fields[name].isNotNull(), F.lit(rule.extract.get(name, {}).get("kind", "account"))) for name in ("instrumentRef", "settlementRef")}
    present = {k: fields[k].isNotNull() for k in fields}
    missing = F.filter(F.array(*(F.when(present.get(r, F.lit(False)), None).otherwise(F.lit(r)) for r in rule.required)) if rule.required else F.array().cast("array<string>"), lambda x: x.isNotNull())
    matched = body.rlike(java_pattern(rule.regex)) if rule.regex else F.lit(True)
    outcome = (
        F.when(F.lit(rule.intent == "ignore"), "ignored")
        .when(~matched, "unparsed")
        .when(F.size(missing) > 0, "unparsed")
        .otherwise("parsed")
    )
    reason = F.when(outcome != "unparsed", None).when(~matched, "extraction_failed").otherwise("required_field_missing")
    spent = F.lit(rule.affects_spend) if rule.affects_spend is not None else F.lit(None).cast("boolean")
    return F.struct(
        outcome.alias("outcome"), reason.alias("reason"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.message_type).alias("message_type"),
        F.lit(rule.sign).cast("string").alias("direction"), spent.alias("affects_spend"), kinds["instrumentRef"].alias("instrument_kind"), kinds["settlementRef"].alias("settlement_kind"), missing.alias("missing"),
        *(fields[k].alias(k) for k in [*MONEY_FIELDS, *MONEY_FIELDS.values(), *TEXT_FIELDS, "occurredAt"]),
    )


_OUT = (
    "outcome string, reason string, rule_id string, message_type string, direction string, affects_spend boolean, instrument_kind string, settlement_kind string, missing array<string>, "
    + ", ".join(f"{k} decimal(20,4)" for k in MONEY_FIELDS) + ", " + ", ".join(f"{k} string" for k in [*MONEY_FIELDS.values(), *TEXT_FIELDS]) + ", occurredAt timestamp"
)


def _empty(outcome: str, reason: str | None) -> Column:
    nulls = ", ".join(f"CAST(NULL AS {part.split(' ', 1)[1]}) AS {part.split(' ', 1)[0]}" for part in re.split(r", (?=\w+ )", _OUT)[2:])
    return F.expr(f"named_struct('outcome', '{outcome}', 'reason', CAST({f"'{reason}'" if reason else 'NULL'} AS STRING), " + ", ".join(f"'{p.rsplit(' AS ', 1)[1]}', {p.rsplit(' AS ', 1)[0]}" for p in re.split(r", (?=CAST)", nulls)) + ")")


def parse_messages(rows: DataFrame, pack: RulePack, sender: str = "address", body: str = "body") -> DataFrame:
    """Adds ``bank_id`` and ``parsed``: outcome not_financial, ignored, unparsed (with a reason) or parsed, and the fields."""
    rows = rows.withColumn("bank_id", bank_of(pack, F.col(sender)))
    text = F.col(body)
    banks = []
    for b in pack.banks:
        rules = _first([(gate(r, text), _extraction(r, text)) for r in b.rules], _empty("unparsed", "no_rule_matched"))
        banks.append((F.col("bank_id") == b.bank_id, rules))
    return rows.withColumn("parsed", _first(banks, _empty("not_financial", None)))


def partial_json(parsed: str = "parsed") -> Column:
    """What was read of a message that lacks required fields, as versioned JSON; an amount goes with its currency only."""
    p = lambda k: F.col(f"{parsed}.{k}")
    both = p("amount").isNotNull() & p("currency").isNotNull()
    parts = F.struct(F.lit(1).alias("v"), F.when(both, p("amount").cast("string")).alias("amount"), F.when(both, p("currency")).alias("currency"), p("merchant").alias("merchant"), p("instrumentRef").alias("instrument"), p("occurredAt").cast("string").alias("occurred_at"))
    return F.when(p("outcome") == "unparsed", F.to_json(parts))


def read_partial(c: Column) -> Column:
    """Decodes the JSON; anything malformed or of another version is null, and half a money pair is dropped."""
    schema = "v int, amount string, currency string, merchant string, instrument string, occurred_at string"
    read = F.from_json(c, F.lit(schema), {"mode": "PERMISSIVE"})
    both = read["amount"].isNotNull() & read["currency"].isNotNull()
    fixed = read.withField("amount", F.when(both, read["amount"])).withField("currency", F.when(both, read["currency"]))
    return F.when(read["v"] == 1, fixed)
