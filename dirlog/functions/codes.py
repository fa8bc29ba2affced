"""Result codes, extended operations, scopes and latency classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of RFC 4511 and its extensions: code to name.
RESULT_CODES = {
    0: "success", 1: "operationsError", 2: "protocolError", 3: "timeLimitExceeded", 4: "sizeLimitExceeded",
    5: "compareFalse", 6: "compareTrue", 7: "authMethodNotSupported", 8: "strongerAuthRequired", 10: "referral",
    11: "adminLimitExceeded", 12: "unavailableCriticalExtension", 13: "confidentialityRequired", 14: "saslBindInProgress",
    16: "noSuchAttribute", 17: "undefinedAttributeType", 18: "inappropriateMatching", 19: "constraintViolation",
    20: "attributeOrValueExists", 21: "invalidAttributeSyntax", 32: "noSuchObject", 33: "aliasProblem", 34: "invalidDNSyntax",
    36: "aliasDereferencingProblem", 48: "inappropriateAuthentication", 49: "invalidCredentials", 50: "insufficientAccessRights",
    51: "busy", 52: "unavailable", 53: "unwillingToPerform", 54: "loopDetect", 64: "namingViolation", 65: "objectClassViolation",
    66: "notAllowedOnNonLeaf", 67: "notAllowedOnRDN", 68: "entryAlreadyExists", 69: "objectClassModsProhibited",
    71: "affectsMultipleDSAs", 80: "other",
}
#: Who is to act on a code; a code in no list is the server's.
INFORMATIONAL, POLICY, POLICY_OR_CLIENT = (0, 5, 6, 10, 14), (3, 4, 11), (8, 13, 50, 53)
CLIENT = (2, 7, 16, 17, 18, 19, 20, 21, 32, 34, 48, 49, 64, 65, 66, 67, 68, 69)
#: Extended operations.
EXT_OIDS = {"1.3.6.1.4.1.1466.20037": "StartTLS", "1.3.6.1.4.1.4203.1.11.1": "PasswordModify", "1.3.6.1.4.1.4203.1.11.3": "WhoAmI", "1.3.6.1.1.8": "Cancel"}
#: Upper bounds of the latency buckets in ms (the last is open), and the logarithmic bins.
BOUNDS = (0, 1, 5, 10, 50, 100, 500, 1000, 2000, 5000)
LOG_MIN, PER_DECADE, LOG_BINS = 1e-3, 5, 35


def lookup(c: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def result_code_name(code: Column) -> Column:
    return F.when(code.isNotNull(), F.coalesce(lookup(code.cast("int"), RESULT_CODES), F.lit("unknown")))


def ext_oid_name(oid: Column) -> Column:
    return F.coalesce(lookup(oid, EXT_OIDS), oid)


def scope_name(scope: Column) -> Column:
    return F.when(scope == 0, "base").when(scope == 1, "one").when(scope == 2, "sub").otherwise(scope.cast("string"))


def result_code_class(code: Column) -> Column:
    named = F.when(code.isin(*INFORMATIONAL), "informational").when(code.isin(*CLIENT), "client").when(code.isin(*POLICY), "policy")
    return F.when(code.isNotNull(), named.when(code.isin(*POLICY_OR_CLIENT), "policy-or-client").otherwise("server"))


def is_error(code: Column) -> Column:
    """True for every code but the informational ones; null stays null."""
    return ~code.isin(*INFORMATIONAL)


def etime_bucket(x: Column) -> Column:
    """0 to 10: the first bound that is not exceeded."""
    out = F.when(x <= BOUNDS[0], 0)
    for i, bound in enumerate(BOUNDS[1:], 1):
        out = out.when(x <= bound, i)
    return F.when(x.isNotNull(), out.otherwise(len(BOUNDS)))


def bucket_label(bucket: Column) -> Column:
    labels = ["0", *(f"{a}-{b}" for a, b in zip(BOUNDS, BOUNDS[1:])), f">{BOUNDS[-1]}"]
    return F.element_at(F.array(*map(F.lit, labels)), bucket + 1)


def etime_log_bin(x: Column) -> Column:
    """0 to 34: five bins a decade from a thousandth on; the last is open."""
    k = ((F.log10(x) - math.log10(LOG_MIN)) * PER_DECADE).cast("int")
    inside = F.greatest(F.lit(0), F.least(F.lit(LOG_BINS - 1), k))
    return F.when(x.isNotNull(), F.when((x > LOG_MIN) & ~F.isnan(x), inside).otherwise(0))


def log_bin_edge(bin: Column) -> Column:
    return F.lit(LOG_MIN) * F.pow(F.lit(10.0), bin / PER_DECADE)


def log_bin_label(bin: Column) -> Column:
    """Lower edge of a bin in µs, ms or s with three significant digits."""
    ms = log_bin_edge(bin)
    value = F.when(ms < 1, ms * 1000).when(ms < 1000, ms).otherwise(ms / 1000)
    digits = F.greatest(F.lit(0), 2 - F.floor(F.log10(value) + 1e-9).cast("int"))
    text = F.regexp_replace(F.when(digits == 0, F.format_string("%.0f", value)).when(digits == 1, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value)), r"(\.\d*?)0+$", "$1")
    return F.concat(F.regexp_replace(text, r"\.$", ""), F.when(ms < 1, F.lit(" µs")).when(ms < 1000, F.lit(" ms")).otherwise(F.lit(" s")))
