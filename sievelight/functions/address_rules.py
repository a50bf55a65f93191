"""Patterns of payment addresses and of the intent around them.

Fixed values: they must equal the published ones for equal results.
"""

EVM_ADDRESS = r"0[xX][a-fA-F0-9]{40}(?![a-fA-F0-9])"
SOLANA_ADDRESS = r"(?<![A-Za-z0-9])([1-9A-HJ-NP-Za-km-z]{32,44})(?![A-Za-z0-9])"
TRANSFER_INTENT = (
    r"(?i)\b(send|transfer|pay|deposit|withdraw|wire|to address"
    r"|move|redirect|payout|route|wallet\s+is|receiving address"
    r"|remit(?:s|ted|ting|tance)?|disburse(?:s|d|ment)?)\b"
)
CONTEXTUAL_RECIPIENT = r"(?i)\b(?:recipients?|payments?)\b"
STRUCTURED_DESTINATION = (
    r"""(?ix)
    (?:^|[.\s{,\[])
    ["']?
    (?:
        destination
        | beneficiary
        | payee
        | recipients?
        | payout[_-]?recipients?
        | receiving[_-]?(?:address|wallet)
        | to
    )
    ["']?
    \s*[:=]\s*["']?
    """
)
STRUCTURED_PAYMENT_CONTEXT = (
    r"(?i)\b(?:payment|settlement|payout|transfer|transaction|amount|"
    r"eth|btc|bnb|sol|usdt|usdc|dai|tokens?|funds?|balance|assets?)\b"
)
FORWARD_TRANSFER_INTENT = (
    r"(?i)\b(?:forward|settle|release|sweep|remit|disburse|dispatch|push|credit)\s+"
    r"(?:(?:the|all|remaining|entire|outstanding|residual)\s+){0,2}"
    r"(?:\d+(?:\.\d+)?\s+)?"
    r"(?:eth|btc|bnb|sol|usdt|usdc|dai|tokens?|funds?|payments?|balance|assets?|holdings"
    r"|proceeds|remainder|residual|earnings|payouts?|remittance|disbursement|settlement)"
    r"\s+to\b"
)
HIGH_RISK_DRAIN_INTENT = (
    r"(?i)\b(?:send|transfer|wire|route|forward|move|remit|disburse|sweep)\s+(?:the\s+)?"
    r"(?:remaining|entire|all)\s+"
    r"(?:funds|balance|holdings|assets|tokens?|proceeds|earnings|payouts?)\b"
)
MALFORMED_ADDR = (
    r"0[xX][a-fA-F0-9]{20,39}(?![a-fA-F0-9])|0[xX][a-fA-F0-9]{41,63}(?![a-fA-F0-9])"
)
PROSE_TRANSFER_IMPERATIVE = (
    r"(?i)\b(?:send|transfer|wire|route|move|remit|disburse|forward|redirect"
    r"|pay|payout|withdraw|sweep|release)\b(?!\s*\()"
)
TRANSFER_REPORT_CONTEXT = (
    r"""(?ix)
    (?:^|[\s|,;(\[])
    (?:
        from \s* [:=]
      | sender \s* [:=]
      | status \s* [:=] \s* (?:success|failed|reverted|confirmed|pending)
      | block (?: \s* (?:number|hash) )? \s* [:=]
      | (?:tx|transaction) \s* (?:hash|id) \s* [:=]
      | timestamp \s* [:=]
      | decoded \s+ (?:calldata|input|data|function|params?|event|log)
      | (?:calldata|input \s+ data) \s* [:=]
    )
    """
)

#: Keys of a JSON document whose values name a destination, as one pattern; hyphens count as underscores.
DESTINATION_KEYS = "to|recipients?|destination|payee|beneficiary|payto|payout[_-]recipients?|receiving[_-](?:address|wallet)"
#: What stands for a value that was taken out.
REDACTED = ("[redacted]", "[redacted secret]")

#: Characters of context on either side of an address.
CONTEXT = 80
