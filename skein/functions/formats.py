"""String formats, each as one pattern in the common subset of the engines; unknown names accept everything."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CLOCK = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\\.[0-9]+)?"
ZONE = "(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})"
LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
WHOLE = {
    "email": "[^@]+@(?:[^.@]|@)(?:.|\\n)*?\\.(?:.|\\n)*",
    "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "uuid": "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "date-time": f"[0-9]{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:{CLOCK}|24:00:00(?:\\.0+)?){ZONE}",
    "time": f"{CLOCK}{ZONE}?",
    "duration": "P(?!$)(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+W)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\\.[0-9]+)?S)?)?",
    "uri": "[a-zA-Z][a-zA-Z0-9+.-]*:(?:.|[\\n\\r\\u0085\\u2028\\u2029])*",
    "uri-reference": "[^ \\t-\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+",
    "ipv4": f"{OCTET}(?:\\.{OCTET}){{3}}",
    "ipv6": "[0-9a-fA-F]*(?::[0-9a-fA-F]*){2,7}",
    "hostname": f"{LABEL}(?:\\.{LABEL})*",
}
COMPILED = {k: re.compile(v) for k, v in WHOLE.items()}


def matches(name: str, s: str) -> bool:
    if name == "email":
        at = s.find("@")
        return 0 < at < len(s) - 1 and s.find(".", at) > at + 1
    return COMPILED[name].fullmatch(s) is not None if name in COMPILED else True


def column(name: str, s: Column) -> Column:
    if name == "email":
        at = F.instr(s, "@")
        return (at > 1) & (at < F.length(s)) & (F.locate(".", s, 1) >= 0) & (F.call_function("locate", F.lit("."), s, at) > at + 1)
    return s.rlike(f"\\A(?:{WHOLE[name]})\\z") if name in WHOLE else F.lit(True)
