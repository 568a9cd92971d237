"""Types that operators share."""

from __future__ import annotations

DOCUMENT = (
    "metadata struct<name:string,description:string,labels:map<string,string>>, "
    "bindings array<struct<name:string,topic:string>>, "
    "fields array<struct<name:string,type:string,required:boolean>>, "
    "rules array<struct<name:string,field:string,operator:string,expected_value:string,severity:string>>"
)
ISSUE = "struct<field:string,message:string>"
ISSUES = f"array<{ISSUE}>"
PROBLEM = f"struct<code:string,message:string,retryable:boolean,issues:{ISSUES}>"
VIOLATION = "struct<rule:string,field:string,operator:string,severity:string,message:string>"
RECORD = "topic string, key string, payload string, headers map<string,string>, partition int, offset bigint, published_at timestamp"

# What documents may hold, problem codes and messages.
FIELD_TYPES = ("string", "integer", "number", "boolean", "timestamp")
OPERATORS = ("required", "not_empty", "equals")
SEVERITIES = ("error", "warn")
LIFECYCLE = ("draft", "validated", "compiled", "active", "inactive", "archived", "rejected")

NOT_FOUND, CONFLICT, INTERNAL, UNAVAILABLE = "SYS_NOT_FOUND", "SYS_CONFLICT", "SYS_INTERNAL", "SYS_UNAVAILABLE"
INVALID, FAILED = "VAL_INVALID_ARGUMENT", "VAL_VALIDATION_FAILED"
EMPTY = "must not be empty"
