"""The detectors, in the order in which ties between their findings are kept."""

from codesift.operators.detectors import access, crypto, injection, secrets

DETECTORS = {
    "fallback_secret": secrets.FALLBACK_SECRET,
    "raw_credential": secrets.RAW_CREDENTIAL,
    "weak_randomness": crypto.WEAK_RANDOMNESS,
    "timing_comparison": crypto.TIMING_COMPARISON,
    "gcm_tag_length": crypto.GCM_TAG,
    "unverified_token": crypto.UNVERIFIED_TOKEN,
    "tls_disabled": crypto.TLS_DISABLED,
    "sql_injection": injection.SQL_INJECTION,
    "command_injection": injection.COMMAND_INJECTION,
    "code_injection": injection.CODE_INJECTION,
    "nosql_injection": injection.NOSQL_INJECTION,
    "prototype_pollution": injection.PROTOTYPE_POLLUTION,
    "path_traversal": injection.PATH_TRAVERSAL,
    "session_secret": secrets.SESSION_SECRET,
    "open_serverless_handler": access.SERVERLESS,
    "open_route": access.ROUTE,
}
