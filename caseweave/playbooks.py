"""Response playbooks: fixed values, one row per action in reading order.

technique | section | id | action | owner | eta_min | rollback | hunt query
"""

# --- fixed values -----------------------------------------------------------
PLAYBOOK_TEXT = """
T1595.002|containment|PB-C-002|Rate-limit {subnet} at the edge to 10 req/min for 60 minutes|Network Ops|5|Remove the rate-limit rule; confirm legitimate traffic unaffected|
T1595.002|containment|PB-C-031|Restrict /actuator/* and /.env to internal networks at the gateway|Platform|10|Restore previous gateway route configuration|
T1595.002|eradication|PB-E-012|Audit {matched_asset} for post-exploitation artefacts and unexpected outbound connections|SOC|45|N/A — read-only investigation|
T1595.002|recovery|PB-R-003|Patch {matched_asset} for {cve} and redeploy|Platform|60|Redeploy the previous image tag|
T1595.002|hunt|PB-H-005|Identify every host exposing an actuator or debug endpoint externally|Platform|30|N/A|SELECT DISTINCT asset_id FROM event WHERE url_path LIKE '/actuator/%' AND http_status = 200
T1592|containment|PB-C-007|Apply progressive rate-limiting to {top_ip} on catalogue endpoints|Network Ops|5|Remove rate-limit rule|
T1592|recovery|PB-R-014|Review robots.txt and consider authentication on bulk catalogue endpoints|AppSec|30|Revert robots.txt|
T1592|hunt|PB-H-009|Quantify catalogue coverage already retrieved by {top_asn}|SOC|20|N/A|SELECT COUNT(DISTINCT url_path) FROM event WHERE asn = {top_asn}
T1110.001|containment|PB-C-018|Enable account lockout after 5 failures on the targeted accounts|IAM|5|Restore previous lockout policy|
T1110.001|containment|PB-C-011|Block ASN {top_asn} at the WAF, 30-minute TTL|Network Ops|5|Remove ASN rule; verify legitimate traffic restored|
T1110.001|eradication|PB-E-007|Revoke all active sessions for the {n_users} targeted account(s)|IAM|2|N/A — users re-authenticate normally|
T1110.001|recovery|PB-R-009|Enable step-up MFA on /login for 24 hours|AppSec|15|Disable the step-up policy|
T1110.001|hunt|PB-H-002|Search all authentication events from ASN {top_asn} over the last 30 days|SOC|15|N/A|SELECT * FROM event WHERE asn = {top_asn} AND url_path = '/login'
T1110.004|containment|PB-C-011|Block ASN {top_asn} at the WAF, 30-minute TTL|Network Ops|5|Remove ASN rule; verify legitimate traffic restored|
T1110.004|containment|PB-C-024|Force password reset for the {n_users} targeted account(s)|IAM|10|N/A — safe-forward|
T1110.004|eradication|PB-E-007|Revoke all active sessions for the affected accounts|IAM|2|N/A|
T1110.004|recovery|PB-R-009|Enable step-up MFA on /login for 24 hours|AppSec|15|Disable the step-up policy|
T1110.004|recovery|PB-R-021|Cross-check targeted accounts against known credential breach corpora|IAM|30|N/A|
T1110.004|hunt|PB-H-002|Search all authentication events from ASN {top_asn} over the last 30 days|SOC|15|N/A|SELECT * FROM event WHERE asn = {top_asn} AND url_path = '/login'
T1078|containment|PB-C-024|Force password reset for the {n_users} compromised account(s) immediately|IAM|10|N/A — safe-forward|
T1078|containment|PB-C-011|Block ASN {top_asn} at the WAF, 30-minute TTL|Network Ops|5|Remove ASN rule|
T1078|eradication|PB-E-007|Revoke every active session and API token for the affected accounts|IAM|2|N/A|
T1078|eradication|PB-E-019|Review actions taken by the compromised account since first successful login|SOC|60|N/A — read-only investigation|
T1078|recovery|PB-R-009|Enable step-up MFA on /login for 24 hours|AppSec|15|Disable the step-up policy|
T1078|hunt|PB-H-011|Identify any other account authenticated from {subnet}|SOC|20|N/A|SELECT DISTINCT user_id FROM event WHERE src_ip LIKE '{subnet}%' AND http_status = 200
T1190|containment|PB-C-031|Restrict the exposed endpoint on {matched_asset} to internal networks|Platform|10|Restore previous gateway route configuration|
T1190|containment|PB-C-011|Block ASN {top_asn} at the WAF, 30-minute TTL|Network Ops|5|Remove ASN rule|
T1190|eradication|PB-E-012|Audit {matched_asset} for post-exploitation artefacts|SOC|45|N/A — read-only|
T1190|recovery|PB-R-003|Patch {matched_asset} for {cve} and redeploy|Platform|60|Redeploy the previous image tag|
T1190|hunt|PB-H-005|Identify every host running the same vulnerable component|Platform|30|N/A|SELECT asset_id, software FROM asset WHERE software LIKE '%Spring%'
T1498|containment|PB-C-041|Enable challenge mode at the edge for {subnet}|Network Ops|3|Disable challenge mode|
T1498|containment|PB-C-011|Block ASN {top_asn} at the WAF, 30-minute TTL|Network Ops|5|Remove ASN rule|
T1498|recovery|PB-R-027|Scale {assets} horizontally and verify autoscaling thresholds|Platform|20|Scale back once traffic normalises|
T1498|hunt|PB-H-014|Determine whether the flood masked activity on other endpoints|SOC|30|N/A|SELECT url_path, COUNT(*) FROM event WHERE asn != {top_asn} GROUP BY url_path
T1041|containment|PB-C-052|Block egress to the destination and isolate {matched_asset}|Network Ops|5|Restore egress once confirmed clean|
T1041|eradication|PB-E-019|Determine what data left, and over what period|SOC|120|N/A — read-only|
T1041|recovery|PB-R-033|Begin breach notification assessment|Legal / Compliance|60|N/A|
T1041|hunt|PB-H-021|Search for the same destination across all assets, last 90 days|SOC|30|N/A|SELECT * FROM event WHERE resp_bytes_60s > 5000000
default|containment|PB-C-001|Rate-limit {top_ip} and monitor for escalation|Network Ops|5|Remove rate-limit rule|
default|hunt|PB-H-001|Review all activity from {subnet} over the last 7 days|SOC|20|N/A|SELECT * FROM event WHERE src_ip LIKE '{subnet}%'
"""


def playbook_rows() -> list[tuple]:
    """(technique, section, section_ord, ordinal, id, action, owner, eta_min, rollback, query)."""
    from .constants import SECTIONS

    rows = []
    for n, line in enumerate(PLAYBOOK_TEXT.strip().splitlines()):
        tech, section, aid, action, owner, eta, rollback, query = line.split("|")
        rows.append((tech, section, SECTIONS.index(section), n, aid, action, owner,
                     int(eta), rollback, query or None))
    return rows
