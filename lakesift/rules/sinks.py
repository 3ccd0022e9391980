"""Calls that take data out, in the order of the kinds."""

from __future__ import annotations

LOG_CALLS = (
    "console.log console.info console.warn console.error console.debug logger.log logger.info logger.warn logger.error logger.debug log.info log.warn log.error log.debug "
    "winston.log winston.info pino.info logging.info logging.warning logging.error logging.debug print"
).split()
LOG_ENDS = ["log", "info", "warn", "error", "debug", "warning", "print"]
DATABASE_ENDS = ["query", "execute", "insert", "update", "save", "create", "findorcreate", "upsert", "add", "commit"]
HTTP_STARTS = ["fetch", "axios.get", "axios.post", "axios.put", "requests.get", "requests.post", "requests.put", "http.get", "http.post", "got", "superagent"]
RESPONSE_ENDS = ["json", "send", "write", "render", "body", "jsonresponse", "jsonify"]
RESPONSE_HOLDERS = ["res", "response", "ctx"]

#: Names of custom sink kinds.
KIND_ALIASES = {
    "log": "log_output", "log_output": "log_output", "db": "database", "database": "database", "api": "third_party_api", "third_party_api": "third_party_api",
    "http": "third_party_api", "res": "response", "response": "response", "file": "file_system", "file_system": "file_system",
}

MASKS = {
    "email": "maskEmail", "phone_number": "maskPhone", "credit_card": "maskCreditCard", "ip_address": "maskIpAddress", "full_name": "maskName", "first_name": "maskName",
    "last_name": "maskName", "national_id": "maskId", "my_number": "maskId", "bsn": "maskId", "nhs": "maskId", "iban": "maskAccount", "bank_account": "maskAccount",
    "password": "redact", "api_key": "redact", "secret_key": "redact", "private_key": "redact",
}
