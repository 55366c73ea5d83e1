"""Texts to work on, as SQL that both Spark and the checking engine understand.

``documents`` holds few kinds of sensitive values, so log lines built from orders and events add
the others. Every table is used whole.
"""

_K = "CAST(o_orderkey AS STRING)"
_H = f"md5({_K})"
_D12 = f"lpad({_K}, 12, '0')"

_KINDS = [
    f"'password=hunter' || {_K} || ' ok'",
    f"'Authorization: Bearer ' || {_H}",
    f"'api_key: sk_' || {_H} || ';'",
    f"'key AKIA' || upper(substr({_H}, 1, 16)) || ' used'",
    f"'aws_secret_access_key=' || {_H} || substr({_H}, 1, 8)",
    f"'aws_account_id: ' || {_D12}",
    f"'assume arn:aws:iam::' || {_D12} || ':role/r' || {_K}",
    f"'session_token=' || {_H} || {_H} || {_H} || {_H}",
    f"'maps AIza' || {_H} || 'abc on'",
    f"'as svc-' || {_K} || '@proj-' || {_K} || '.iam.gserviceaccount.com'",
    f"'project_id=proj-' || {_K} || '-eu'",
    f"'tenant_id=' || substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-' || substr({_H}, 13, 4)"
    f" || '-' || substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12)",
    f"'client_secret=' || {_H} || 'zz.'",
    f"'DefaultEndpointsProtocol=https;AccountName=acc' || {_K} || ';AccountKey=' || {_H} || {_H}"
    f" || substr({_H}, 1, 24) || ';EndpointSuffix=core.windows.net done'",
    f"'get https://acc.example.com/c?sv=2020&se=2021&sr=b&sp=r&sig=' || {_H}",
    f"'from 10.' || CAST(o_custkey % 256 AS STRING) || '.0.' || CAST(o_orderkey % 256 AS STRING)"
    f" || ' to 2001:db8:' || substr({_H}, 1, 4) || ':1'",
    f"'host=db' || {_K} || '.prod.internal'",
    f"'url=https://api' || {_K} || '.corp:8443/v1/orders/' || {_K} || ' host=api.corp'",
    f"'http://192.168.1.' || CAST(o_orderkey % 256 AS STRING) || '/x then localhost'",
    f"'mail user' || {_K} || '@example.com or +1 (' || CAST(200 + o_custkey % 700 AS STRING)"
    f" || ') 555-' || lpad({_K}, 4, '0')",
    f"'card 4111 ' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || ' 1111 '"
    f" || lpad(CAST(o_orderkey * 7 % 10000 AS STRING), 4, '0')",
    f"'iban DE' || lpad(CAST(98 - (o_orderkey * 1000000 + 131400) % 97 - o_custkey % 2 AS STRING), 2, '0')"
    f" || lpad({_K}, 18, '0')",
    f"'ssn ' || lpad(CAST(o_orderkey * 37 % 1000 AS STRING), 3, '0') || '-12-'"
    f" || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')",
    f"'passport no. A' || lpad({_K}, 8, '0')",
    f"'see https://example.com/o/' || {_K} || ' at 14:32:01'",
    f"'jwt eyJ' || {_H} || '.' || {_H} || '.' || {_H}",
    f"'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {_H} || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10) || 'x'",
    f"'clean line ' || {_K}",
    f"'password=10.0.0.1' || chr(10) || 'pwd: a' || {_K} || chr(10) || 'user bob'",
    f"'10.0.0.1, 10.0.0.2,' || chr(10) || '10.0.0.3 and b' || {_K} || '@x.org; \"api-key\": none'",
]

ORDER_LOG = (
    "SELECT o_orderkey AS id, 'src' || CAST(o_custkey % 5 AS STRING) AS source,"
    f" 'order ' || {_K} || ' ' || CASE o_orderkey % {len(_KINDS)} "
    + " ".join(f"WHEN {i} THEN {kind}" for i, kind in enumerate(_KINDS))
    + " END AS text FROM orders"
)

DOCUMENTS = "SELECT doc_id AS id, source, text FROM documents"
CONVERSATIONS = "SELECT conv_id * 1000 + turn AS id, role AS source, text FROM conversations"
PAGES = "SELECT page_id AS id, 'web' AS source, html AS text FROM pages"

# One hot session: user 0 gets a third of all events.
EVENT_TEXTS = (
    "SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS session, event_id AS seq,"
    " CASE event_id * 7 % 11 WHEN 0 THEN 'password=secret' || CAST(user_id AS STRING)"
    " WHEN 1 THEN '[REDACTED]' WHEN 2 THEN '' WHEN 3 THEN 'password=10.0.0.1'"
    " WHEN 4 THEN 'password=[IP_ADDRESS]' WHEN 5 THEN event_type"
    " WHEN 6 THEN 'ip 10.0.0.' || CAST(user_id % 256 AS STRING)"
    " ELSE 'password=10.0.0.1' END AS text FROM events"
)
