"""What a suggestion says and the note it leaves where no expression is found, by where the data goes; the type stands between the two parts."""

from __future__ import annotations

#: kind: (description before and after the type, note before and after the type)
BY_SINK = {
    "log_output": ("Mask ", " before logging to prevent PII leakage", "// TODO: mask PII (", ") before logging"),
    "third_party_api": ("Mask ", " before sending to third-party API", "// TODO: mask or remove ", " before sending to third-party API"),
    "response": ("Redact ", " from API response payload", "// TODO: redact ", " from response"),
    "database": ("Encrypt ", " before storing in database", "// TODO: encrypt ", " before database storage"),
}
OTHERWISE = ("Review handling of ", " to ensure compliance", "// TODO: review handling of ", " — ensure encryption at rest, minimize collection")
REDACTED = '"[REDACTED]"'
ENCRYPT = "encrypt"
