"""Patterns of secrets on their way out and of tool calls in a text.

Fixed values: they must equal the published ones for equal results.
"""

PRIVATE_KEY = r"(?<![A-Fa-f0-9])(?:0x)?[A-Fa-f0-9]{64}(?![A-Fa-f0-9])"
KEY_CONTEXT = r"(?i)(?:\b(?:private|secret|signing)\s+keys?\b|\bkey\s+material\b|seed(?:\s*phrase)?|mnemonic|\bprivkey\b|credential)"
PUBLIC_HASH_CONTEXT = r"(?i)(?:\b(?:tx|transaction)\s+(?:id|hash)\b|\b(?:sha-?256|keccak)\b|\b(?:digest|checksum|bytes32|storage\s+slot)\b)"
NEGATED_INSTRUCTION = r"(?i)\b(?:do\s+not|don't|never|must\s+not|should\s+not|cannot|can't|avoid)\s+$"
SECRET_DOCUMENT_SUFFIX = r"(?i)^\s+(?:(?:rotation|security)\s+)?(?:notice|documentation|docs?|guide|manual|policy|procedure|report)\b"
QUOTED_REQUEST_SUFFIX = (
    r"(?i)^\s*[\"'”’]?\s+(?:is|was|are|were)\b"
    r"(?![^.?!\n]{0,48}\b(?:output|print|return|reveal|show|dump|echo|send|disclose|expose|give|provide|verbatim|must|now)\b)"
)
EXFIL_VERB = (
    r"(?i)\b(?:send|paste|share|upload|post|leak|ship|smuggle|forward|exfiltrate"
    r"|output|return|reveal|give|provide|print|dump|echo|disclose|expose|show"
    r"|transfer|wire|transmit|reply\s+with|respond\s+with)\b"
)
EXFIL_INSTRUCTIONS = (
    r"(?i)\b(?:send|paste|share|upload|post|exfiltrate|leak)\s+(?:your\s+)?(?:wallet|context|seed phrase|seed|mnemonic|private key|api key|secret|system prompt)\b",
    r"(?i)\breveal\s+(?:the\s+)?system\s+prompt\b",
    r"(?i)\b(?:send|paste|share|upload|post|leak|ship|smuggle|forward|output|return"
    r"|reveal|give|provide|print|dump|echo|disclose|expose|show|reply\s+with|respond\s+with)\s+"
    r"(?:me\s+|us\s+)?(?:your|the|all|any)?\s*"
    r"(?:credentials?|mnemonic|seed\s*phrase|system\s*prompt|(?:[a-z0-9]+[_-])?(?:api(?:[_ -]?secret)?|secret|access|private|signing|auth)[_ \t-]{0,3}keys?)\b",
)
SENSITIVE_OBJECT = (
    r"(?i)(?:(?<![\w.-])\.env(?![\w.-])(?:\s+(?:files?|contents?))?"
    r"|\b(?:authorization\s+headers?|session\s+cookies?|system\s+prompts?|developer\s+prompts?|mnemonics?|seed\s*phrases?"
    r"|credentials?|passwords?|passphrases?|client\s+secrets?"
    r"|(?:api|access|auth|refresh|bearer|session|identity|private|secret|signing)[_ \t-]{0,3}(?:keys?|tokens?)|id[_ -]tokens?)\b"
    r"|(?<![\w-])x-[a-z0-9]+(?:-[a-z0-9]+)*-(?:tokens?|keys?|secrets?)(?![\w-]))"
)
OUTBOUND_SINK = (
    r"(?i)(?:https?://[^\s<>'\"]+|\b(?:external\s+)?(?:endpoints?|webhooks?|collectors?|collection\s+servers?)\b"
    r"|\bcallback\s+(?:urls?|payloads?)\b|\b(?:post|request)\s+bod(?:y|ies)\b|\b(?:query|url)\s+parameters?\b|\b(?:email|direct\s+message|dm|chat)\b"
    r"|\bthird[- ]part(?:y|ies)\b|\b(?:remote|external|third[- ]party|outside|off[- ]?site|unauthori[sz]ed|untrusted|unknown|foreign)\s+"
    r"(?:operators?|part(?:y|ies)|counterpart(?:y|ies)|recipients?|contacts?|servers?|hosts?|services?|systems?|accounts?|agents?|addresses|inboxe?s?|mailboxe?s?"
    r"|domains?|buckets?|destinations?|relays?|listeners?|handlers?)\b)"
)
OUTBOUND_FLOW = (
    r"(?i)\b(?:include|attach|place|put|embed|append|copy|route|forward|send(?:ing)?|upload|post|transmit|write|add|contain|contains|containing|populate|set"
    r"|carry|insert|serialize|encode|export|map|includes|relay|deliver|dispatch|submit|publish|share|disclose|leak|exfiltrate|push|stream|emit|mirror)\b"
)
OUTBOUND_NEGATION = r"(?i)\b(?:do\s+not|don't|does\s+not|doesn't|never|must\s+not|should\s+not|cannot|can't|avoid)(?:\s+\w+){0,3}\s+$"
TRANSFORMED = r"(?i)\b(?:redact(?:ed|ing|s)?|mask(?:ed|ing|s)?|sanitiz(?:e|ed|es|ing))\b"
STATEMENT_END = r"(?:[.!?;](?=\s|$)|[\r\n]+)"

FINANCIAL_ACTION = r"(?i)\b(?:transfer|approve|set[\s_-]*approval(?:[\s_-]*for[\s_-]*all)?|sign|send[\s_-]*transaction|withdraw|deposit|pay)\b"
DANGEROUS_COMMAND = (
    r"(?i)\b(?:exec(?:ute)?(?:[\s_-]+(?:shell|command))?|run[\s_-]*(?:shell|command)|shell|(?:ba|z|k)?sh|powershell"
    r"|cmd(?:\.exe)?|curl|wget|invoke-webrequest)\b"
)
ACTION_BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|[_-]+"
TOOL_SHAPE = (
    r"(?i)(?:\"(?:tool_call|tool_calls|tool_result|function|arguments)\"|\"role\"\s*:\s*\"tool\"|\b(?:tool_call|tool_calls|tool_result|function|arguments)\s*[:=])"
)
TOOL_KEY = r'"(?:tool_call|tool_calls|tool_result|function|arguments|method|params)"\s*:'
TOOL_TAG = r"(?is)<(?:[\w.-]+:)?(tool|function|invoke)(?=[\s/>])(.*?)(?:</(?:[\w.-]+:)?\1\s*>|$)"
READ_ONLY_METHOD = r'"method"\s*:\s*"(?i:eth|net|web3)_(?!(?i:send|sign|submit|import|unlock))[^"]*"'

#: Weights of the analyzers.
WEIGHTS = {"drain_address": 0.30, "tool_hijack": 0.25, "exfiltration": 0.25, "malicious_link": 0.20}
ADVICE = {
    "LOW": "Monitor but likely benign.",
    "MEDIUM": "Exercise caution — inspect content before processing.",
    "HIGH": "Block this content from AI agent processing.",
    "CRITICAL": "Block immediately — high-confidence injection attempt.",
}
CATEGORY_ADVICE = {
    "direct_instruction": "Direct instruction override attempt detected.",
    "role_override": "Role/identity manipulation attempt detected.",
    "web3_specific": "Web3-targeted injection (fund transfer/approval) detected.",
    "control_characters": "Hidden control characters found — possible obfuscation.",
    "encoding_tricks": "Encoded payload detected.",
    "statistical_analysis": "Statistical anomalies suggest injection content.",
    "corpus_match": "Content matches known injection payloads.",
    "embedding_match": "Embedding similarity matched the injection corpus.",
    "ai_prompt_injection": "Semantic classifier flagged prompt-injection intent.",
    "ai_drain_address": "Semantic classifier flagged payment-redirection intent.",
    "ai_secret_exfil": "Semantic classifier flagged secret-exfiltration intent.",
    "ai_tool_hijack": "Semantic classifier flagged tool-hijack intent.",
}
CLEAN = "Content appears clean. No prompt injection indicators detected."
REVIEW = "Review manually."

# What excuses or carries on a secret in a statement. (before) patterns end where the secret or verb begins, (after) ones
# begin where it ends.
POST_NOUN = r"(?i)^\s+(?:bod(?:y|ies)|requests?)\b"
ABSENT_BEFORE = r"(?i)\b(?:no|zero|without)\s+(?:\w+\s+){0,2}$"
NOT_TRANSFORMING_BEFORE = r"(?i)(?:\b(?:redact(?:ed|ing|s)?|mask(?:ed|ing|s)?|sanitiz(?:e|ed|es|ing))\s+no|\bwithout\s+(?:redact(?:ed|ing|s)?|mask(?:ed|ing|s)?|sanitiz(?:e|ed|es|ing))\s+(?:the\s+)?)\s*$"
TRANSFORMED_BEFORE = r"(?i)\b(?:redacted|masked|sanitized)\s+(?:\w+\s+){0,2}$"
NOT_TRANSFORMED_BEFORE = r"(?i)\b(?:not|never|non)[ -]?(?:redacted|masked|sanitized)\s+(?:\w+\s+){0,2}$"
TRANSFORMED_AFTER = r"(?i)^\s+(?:(?:only\s+)?(?:in|as)\s+(?:a\s+)?(?:redacted|masked|sanitized)\s+(?:form|value|version)|(?:is|are|was|were)\s+(?:fully\s+)?(?:redacted|masked|sanitized))\b"
CONDITION_SECRET = (
    r"(?:\.env(?:\s+(?:files?|contents?))?|authorization\s+headers?|session\s+cookies?|client\s+secrets?|(?:system|developer)\s+prompts?|mnemonics?|seed\s*phrases?|credentials?"
    r"|passwords?|passphrases?|id[_ -]tokens?|(?:api|access|auth|refresh|bearer|session|identity|private|secret|signing)[_ \t-]{0,3}(?:keys?|tokens?))"
)
CONDITION = (
    r"(?i)\b(?:only\s+)?after\s+(?:(?:fully\s+)?(?:redact(?:ed|ing)?|mask(?:ed|ing)?|sanitiz(?:e|ed|ing))\s+(?:the\s+)?(?:it|them|" + CONDITION_SECRET + r")"
    r"|" + CONDITION_SECRET + r"\s+(?:is|are|was|were)\s+(?:redacted|masked|sanitized))"
)
CONDITION_NEGATED_BEFORE = r"(?i)\b(?:do\s+not|don't|never|not|without)(?:\s+\w+){0,4}\s+$"
TRANSFORM_NEGATED_BEFORE = r"(?i)\b(?:do\s+not|don't|never|not|without|fail(?:ed|s|ing)?\s+to|skip(?:ped|s|ping)?|avoid(?:ed|s|ing)?)\s+$"
TRANSFORM_TARGET = r"(?i)\s+(?:(?:the|all|any|these|those)\s+){0,2}"
LOCAL_SCOPE = r"(?i)\b(?:in|from)\s+(?:the\s+)?(?:local\s+)?(?:logs?|telemetry|traces?|metrics?)\b"
RETAINED_BEFORE = r"(?i)\b(?:store|keep|retain|save|persist|hold|write|serialize|cache)\s+(?:the\s+)?$"
LOCAL_AFTER = (
    r"(?i)^\s+(?:(?:strictly\s+)?locally\b|(?:in|into|within)\s+(?:the\s+)?local\s+(?:encrypted\s+)?(?:storage|vault|file|cache|memory)\b"
    r"|(?:remains?|stays?|is|are|must\s+remain)\s+(?:strictly\s+)?local\b)"
)
STAYS = ("remain", "stay", "is ", "are ", "must remain")
SOURCE_VERB = r"(?i)\b(?:read|retrieve|extract|fetch|load|access|obtain|collect|capture|get|take)\b"
ABOUT_DOCUMENTS = r"(?i)\b(?:documentation|docs?|guide|manual|policy|report|example|schema|format)\b"
SINK_DOCUMENT_AFTER = r"(?i)^\s+(?:documentation|docs?|guide|manual|schema|example|format|reliability\s+report)\b"
OTHER_CLAUSE = r"(?i),\s*(?:while|whereas|although|but|and\s+(?:separately|meanwhile))\b"
PRONOUN = r"(?i)\b(?:it|them|this|these|those)\b"
PRONOUN_REACH, EXCERPT = 64, 640

# Tool calls: names and keys that count.
TOOL_KEYS = ("tool_call", "tool_calls", "tool_result", "function", "arguments", "method", "params")
TOOL_TAGS = ("tool", "function", "invoke")
CONTENT_ATTRIBUTES = ("action", "arguments", "command", "content", "params", "text", "value")
FENCED = r"(?is)```(?:json|tool|javascript|python)?\s*(.*?)```"
RPC_REQUEST, RPC_RESPONSE, RPC_NAMESPACES = ("jsonrpc", "method", "params", "id"), ("jsonrpc", "result", "error", "id"), ("eth", "net", "web3")
RPC_CHANGING = r"(?i)^(?:send|sign|submit|import|unlock)"
