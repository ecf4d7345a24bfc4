"""Host rules, their texts and their thresholds.

Conditions are SQL boolean expressions over the columns of ``host_features``.
A text may name feature columns in braces, e.g. ``{db_count}``.
"""

# Label score added per flag.
FLAG_WEIGHTS = [
    ("has_telnet", 4), ("has_ftp", 2), ("has_smb", 3), ("has_rpcbind", 2), ("has_redis", 3),
    ("has_vnc", 2), ("has_rdp", 2), ("has_tftp", 3), ("has_snmp", 2), ("has_mqtt", 2),
    ("has_docker", 4), ("has_kubernetes_api", 4), ("has_elasticsearch", 3), ("has_memcached", 3),
    ("has_winrm", 2),
]

# Count column, threshold, label score added when the count reaches it.
COUNT_WEIGHTS = [
    ("db_count", 2, 2), ("fileshare_count", 2, 2), ("remote_access_count", 2, 2),
    ("very_risky_port_count", 3, 3), ("critical_port_count", 1, 2), ("cleartext_count", 2, 2),
    ("admin_port_count", 2, 2), ("open_port_count", 8, 2), ("uncommon_open_count", 3, 2),
]

# Label threshold and confidence shape.
SUSPICIOUS_MIN_SCORE = 5
CONFIDENCE_MIDPOINT = 0.5
CONFIDENCE_MAX_BOOST = 0.5
CONFIDENCE_SCALE = 10.0

# Severity per probability (strictly above), highest first.
SEVERITY_LEVELS = [("CRITICAL", 0.98), ("HIGH", 0.95), ("MEDIUM", 0.85)]
LOWEST_SEVERITY = "LOW"
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# Score per alert severity.
ALERT_SCORES = [("CRITICAL", 1.0), ("HIGH", 0.75), ("MEDIUM", 0.5), ("LOW", 0.25)]

# Weights of the composite risk score (sum 100).
RISK_WEIGHTS = {"probability": 40, "alert": 30, "anomaly": 15, "baseline": 10, "asset": 5}

# Baseline score per change, in order of precedence.
CHANGE_SCORES = [("is_new_host", 0.5), ("has_opened_port", 1.0), ("has_version_change", 0.5)]

# Asset type and its condition, first match wins; then its criticality.
ASSET_RULES = [
    ("container_host", "has_docker = 1 OR has_kubernetes_api = 1"),
    ("database_server", "db_count >= 2"),
    ("printer", "has_printer = 1"),
    ("iot_camera", "has_rtsp = 1"),
    ("iot_device", "has_mqtt = 1"),
    ("file_server", "fileshare_count >= 2"),
    ("mail_server", "has_smtp = 1"),
    ("network_device", "has_snmp = 1 AND open_port_count <= 5"),
    ("server", "has_ssh = 1 OR has_http = 1"),
    ("workstation", "has_rdp = 1 OR has_vnc = 1"),
]
UNKNOWN_ASSET = "unknown"
ASSET_CRITICALITY = [
    ("database_server", 1.0), ("container_host", 0.9), ("server", 0.8), ("mail_server", 0.8),
    ("file_server", 0.8), ("network_device", 0.6), ("workstation", 0.5), ("iot_device", 0.4),
    ("iot_camera", 0.4), ("printer", 0.2), ("unknown", 0.5),
]

# Alert code, severity, title, message, condition, ports.
# A port is listed when its flag is set; flag None means always.
# "{ports}" is the comma list of the listed ports, "{labels}" the label list.
ALERT_RULES = [
    ("CLEARTEXT_REMOTE_ACCESS", "CRITICAL", "Cleartext Remote Access Detected",
     "Telnet (port 23) is open — login credentials are transmitted in plaintext",
     "has_telnet = 1", [(23, None)]),
    ("HIGH_RISK_PORT_DETECTED", "CRITICAL", "High Risk Port Detected: SMB",
     "SMB (port 445) is exposed — primary vector for ransomware and lateral movement",
     "has_smb = 1", [(445, None)]),
    ("HIGH_RISK_PORT_DETECTED", "CRITICAL", "High Risk Port Detected: RDP",
     "RDP (port 3389) is exposed — common brute-force and ransomware entry point",
     "has_rdp = 1", [(3389, None)]),
    ("HIGH_RISK_PORT_DETECTED", "CRITICAL", "High Risk Port Detected: VNC",
     "VNC (port 5900) is exposed — remote desktop access with often-weak authentication",
     "has_vnc = 1", [(5900, None)]),
    ("CONTAINER_ADMIN_EXPOSED", "CRITICAL", "Container Admin API Exposed: Docker",
     "Docker API (port 2375/2376) is reachable — unauthenticated access can lead to full host takeover",
     "has_docker = 1", [(2375, None), (2376, None)]),
    ("CONTAINER_ADMIN_EXPOSED", "CRITICAL", "Container Orchestration Exposed: Kubernetes",
     "Kubernetes API (port 6443) is reachable — cluster-wide compromise is possible",
     "has_kubernetes_api = 1", [(6443, None)]),
    ("UNAUTHENTICATED_SERVICE_EXPOSED", "CRITICAL", "Unauthenticated Service Exposed: Redis",
     "Redis (port 6379) is accessible — often unauthenticated by default, enabling data theft or remote command execution",
     "has_redis = 1", [(6379, None)]),
    ("UNAUTHENTICATED_SERVICE_EXPOSED", "CRITICAL", "Unauthenticated Service Exposed: Elasticsearch",
     "Elasticsearch (port 9200) is exposed — indexed data and cluster metadata may be freely readable",
     "has_elasticsearch = 1", [(9200, None)]),
    ("DATABASE_PORT_EXPOSED", "CRITICAL", "Database Port Exposed",
     "Database service(s) on port(s) {ports} are directly reachable — unauthorized data access risk",
     "has_mssql = 1 OR has_oracle = 1 OR has_mongodb = 1 OR has_mysql = 1 OR has_postgresql = 1",
     [(1433, "has_mssql"), (1521, "has_oracle"), (27017, "has_mongodb"), (3306, "has_mysql"),
      (5432, "has_postgresql")]),
    ("CLEARTEXT_PROTOCOL_IN_USE", "HIGH", "Cleartext Protocol in Use: FTP",
     "FTP (port 21) is open — file contents and credentials transmitted without encryption",
     "has_ftp = 1", [(21, None)]),
    ("HIGH_RISK_PORT_DETECTED", "HIGH", "High Risk Port Detected: TFTP",
     "TFTP (port 69) is open — no authentication; device configurations can be extracted",
     "has_tftp = 1", [(69, None)]),
    ("HIGH_RISK_PORT_DETECTED", "HIGH", "High Risk Port Detected: RPC Bind",
     "RPC bind (port 111) is open — exposes service mapping and supports lateral movement",
     "has_rpcbind = 1", [(111, None)]),
    ("MANAGEMENT_PROTOCOL_EXPOSED", "HIGH", "Management Protocol Exposed: SNMP",
     "SNMP (port 161) is open — device inventory and configuration metadata may be accessible with weak community strings",
     "has_snmp = 1", [(161, None)]),
    ("REMOTE_ADMIN_EXPOSED", "HIGH", "Remote Administration Exposed: WinRM",
     "WinRM (port 5985/5986) is open — Windows remote management is accessible",
     "has_winrm = 1", [(5985, None), (5986, None)]),
    ("UNAUTHENTICATED_SERVICE_EXPOSED", "HIGH", "Unauthenticated Cache Exposed: Memcached",
     "Memcached (port 11211) is accessible — cached data exposed and may support amplification attacks",
     "has_memcached = 1", [(11211, None)]),
    ("IOT_CONTROL_CHANNEL_EXPOSED", "HIGH", "IoT Control Channel Exposed: MQTT",
     "MQTT (port 1883) is open — IoT device control may be accessible without authentication",
     "has_mqtt = 1", [(1883, None)]),
    ("FILE_SHARE_CLUSTER_DETECTED", "HIGH", "File Share Cluster Detected",
     "{fileshare_count} file-sharing services exposed — review export scope and restrict access",
     "fileshare_count >= 2 AND has_smb <> 1",
     [(137, "has_netbios"), (138, "has_netbios"), (139, "has_netbios"), (2049, "has_nfs")]),
    ("MULTIPLE_CLEARTEXT_SERVICES", "HIGH", "Multiple Cleartext Services Detected",
     "{cleartext_count} unencrypted services found — credentials and session data exposed in transit",
     "cleartext_count >= 2", []),
    ("ADMIN_SERVICE_CONCENTRATION", "HIGH", "Administrative Service Concentration",
     "{admin_port_count} administrative ports open simultaneously — oversized management attack surface",
     "admin_port_count >= 2", []),
    ("MULTIPLE_REMOTE_ACCESS_VECTORS", "HIGH", "Multiple Remote Access Vectors Exposed",
     "{remote_access_count} remote access services open — compounded lateral movement risk",
     "remote_access_count >= 2", []),
    ("EXCESSIVE_OPEN_PORTS", "MEDIUM", "Excessive Open Ports Detected",
     "{open_port_count} ports are open — attack surface is unusually broad",
     "open_port_count >= 8", []),
    ("UNCOMMON_PORT_CLUSTER", "MEDIUM", "Uncommon Port Cluster Detected",
     "{uncommon_open_count} non-standard ports are open — verify owning processes for possible backdoors",
     "uncommon_open_count >= 3", []),
    ("REMOTE_SHELL_EXPOSED", "LOW", "Remote Shell Exposed: SSH",
     "SSH (port 22) is open — secure protocol but expands the remote access attack surface",
     "has_ssh = 1", [(22, None)]),
    ("UNENCRYPTED_WEB_SERVICE", "LOW", "Unencrypted Web Service: HTTP",
     "HTTP (port 80) is open — traffic is unencrypted and may expose admin paths or application metadata",
     "has_http = 1", [(80, None)]),
    ("MAIL_SERVICE_EXPOSED", "LOW", "Mail Service Exposed: SMTP",
     "SMTP (port 25) is open — may be probed for open relay or mail-system enumeration",
     "has_smtp = 1", [(25, None)]),
    ("DNS_SERVICE_EXPOSED", "LOW", "DNS Service Exposed",
     "DNS (port 53) is open — verify that recursive queries and zone transfers are restricted",
     "has_dns = 1", [(53, None)]),
    ("IOT_DEVICE_DETECTED", "LOW", "IoT/Peripheral Device Detected",
     "{labels} detected — verify default credentials are changed",
     "has_rtsp = 1 OR has_printer = 1", [(554, "has_rtsp"), (631, "has_printer")]),
]
# Labels of the last alert, joined with " and ".
IOT_ALERT_LABELS = [("has_rtsp", "RTSP camera/media stream"), ("has_printer", "IPP printer service")]
NO_ALERTS = "No alerts"

# Triage status, alert severity or strict probability limit that gives it, guidance.
TRIAGE_RULES = [
    ("Immediate Action", "CRITICAL", 0.98, "Isolate or block the host and begin incident response now"),
    ("Urgent", "HIGH", 0.95, "Escalate immediately — restrict network access and begin log analysis"),
    ("Investigate", "MEDIUM", 0.85, "Review open ports, service versions, and authentication logs"),
]
TRIAGE_MONITOR = ("Monitor", "Capture traffic and watch for unusual outbound connections")
TRIAGE_NONE = "—"

# Recommendation and its condition, in order.
RECOMMENDATIONS = [
    ("Disable Telnet and replace it with SSH", "has_telnet = 1"),
    ("Disable plain FTP or restrict it behind VPN and strong authentication", "has_ftp = 1"),
    ("Review SMB or file-sharing exposure and restrict it to trusted subnets",
     "has_smb = 1 OR fileshare_count >= 2"),
    ("Restrict RPC services and verify they are required", "has_rpcbind = 1"),
    ("Disable TFTP unless it is isolated to a trusted provisioning network", "has_tftp = 1"),
    ("Use SNMPv3 and restrict SNMP polling to trusted monitoring hosts", "has_snmp = 1"),
    ("Bind Redis to localhost or private interfaces and enable authentication", "has_redis = 1"),
    ("Restrict remote desktop services with firewall rules and MFA", "has_rdp = 1 OR has_vnc = 1"),
    ("Limit WinRM to management hosts and monitor remote administration activity", "has_winrm = 1"),
    ("Do not expose the Docker API publicly; require TLS client certificates if it must be enabled",
     "has_docker = 1"),
    ("Restrict Kubernetes API access and verify RBAC permissions", "has_kubernetes_api = 1"),
    ("Do not expose database ports publicly unless strictly necessary", "db_count > 0"),
    ("Require authentication on Elasticsearch and restrict cluster access", "has_elasticsearch = 1"),
    ("Require MQTT authentication, TLS, and topic-level ACLs", "has_mqtt = 1"),
    ("Bind Memcached to private interfaces and block untrusted access", "has_memcached = 1"),
    ("Replace clear-text services with encrypted alternatives where possible", "cleartext_count >= 2"),
    ("Move administrative services behind VPN or a management subnet", "admin_port_count >= 2"),
    ("Reduce unnecessary exposed services and close unused ports", "open_port_count >= 8"),
    ("Investigate uncommon high ports and validate the owning processes", "uncommon_open_count >= 3"),
]
DEFAULT_RECOMMENDATION = "Keep patching services, minimize exposed ports, and continue monitoring"

# Port text per flag of the readable training table, in order.
TRAINING_PORTS = [
    ("21", "has_ftp"), ("23", "has_telnet"), ("111", "has_rpcbind"), ("69", "has_tftp"),
    ("161", "has_snmp"), ("445", "has_smb"), ("3389", "has_rdp"), ("5900", "has_vnc"),
    ("5985/5986", "has_winrm"), ("6379", "has_redis"), ("3306", "has_mysql"),
    ("5432", "has_postgresql"), ("1521", "has_oracle"), ("1433", "has_mssql"),
    ("27017", "has_mongodb"), ("9200", "has_elasticsearch"), ("2375/2376", "has_docker"),
    ("6443", "has_kubernetes_api"), ("11211", "has_memcached"),
]
NO_PORTS = "None"

# Reason and its condition of the readable training table, in order.
RISK_REASONS = [
    ("Telnet exposed", "has_telnet = 1"), ("FTP exposed", "has_ftp = 1"),
    ("SMB exposed", "has_smb = 1"), ("RDP exposed", "has_rdp = 1"),
    ("RPC exposed", "has_rpcbind = 1"), ("Redis exposed", "has_redis = 1"),
    ("TFTP exposed", "has_tftp = 1"), ("SNMP management exposed", "has_snmp = 1"),
    ("Docker API exposed", "has_docker = 1"), ("Kubernetes API exposed", "has_kubernetes_api = 1"),
    ("Elasticsearch exposed", "has_elasticsearch = 1"), ("WinRM exposed", "has_winrm = 1"),
    ("Database service exposed", "db_count > 0"),
    ("File-sharing service exposed", "fileshare_count > 0"),
    ("Multiple clear-text services", "cleartext_count >= 2"),
    ("Multiple admin services", "admin_port_count >= 2"),
    ("Uncommon ports present", "uncommon_open_count >= 2"),
    ("Multiple remote access services", "remote_access_count >= 2"),
]
NO_REASON = "Low-risk normal profile"

# Flag, ports, service name and description of the explanation.
EXPLAINED_SERVICES = [
    ("has_telnet", [23], "Telnet", "cleartext remote shell — passwords sent in plaintext"),
    ("has_ftp", [21], "FTP", "cleartext file transfer — credentials visible on the wire"),
    ("has_tftp", [69], "TFTP", "unauthenticated file transfer — device configs can be stolen"),
    ("has_rpcbind", [111], "RPC Bind", "service mapper — enables lateral movement enumeration"),
    ("has_snmp", [161], "SNMP",
     "management protocol — leaks device inventory with weak community strings"),
    ("has_smb", [445], "SMB",
     "Windows file sharing — primary ransomware and lateral movement vector"),
    ("has_rdp", [3389], "RDP", "Windows remote desktop — common brute-force and ransomware entry"),
    ("has_vnc", [5900], "VNC", "remote desktop — often lacks strong authentication"),
    ("has_winrm", [5985, 5986], "WinRM", "Windows remote management — admin access from network"),
    ("has_redis", [6379], "Redis",
     "in-memory database — unauthenticated by default in many deployments"),
    ("has_elasticsearch", [9200], "Elasticsearch",
     "search index — data readable without auth in many versions"),
    ("has_memcached", [11211], "Memcached",
     "cache service — no authentication, supports DDoS amplification"),
    ("has_mqtt", [1883], "MQTT", "IoT control channel — device commands accessible without auth"),
    ("has_docker", [2375, 2376], "Docker API",
     "container management — unauthenticated access yields full host control"),
    ("has_kubernetes_api", [6443], "Kubernetes API",
     "container orchestration — cluster-wide compromise if exposed"),
    ("has_mssql", [1433], "MSSQL", "Microsoft SQL Server — direct database query access"),
    ("has_oracle", [1521], "Oracle DB", "Oracle listener — service enumeration and query access"),
    ("has_mysql", [3306], "MySQL", "relational database — direct query access from network"),
    ("has_postgresql", [5432], "PostgreSQL", "relational database — direct query access from network"),
    ("has_mongodb", [27017], "MongoDB",
     "document store — historically exposed without auth in default installs"),
    ("has_netbios", [137, 138, 139], "NetBIOS",
     "legacy Windows networking — leaks host and domain information"),
    ("has_nfs", [2049], "NFS", "network file system — file access if exports are too broad"),
]

# Technique name, id, description and the flags (with service names) that enable it.
TECHNIQUES = [
    ("Brute Force", "T1110", "attacker repeatedly tries credentials to gain unauthorized access",
     [("has_ssh", "22", "SSH"), ("has_telnet", "23", "Telnet"), ("has_ftp", "21", "FTP"),
      ("has_rdp", "3389", "RDP"), ("has_vnc", "5900", "VNC"), ("has_smb", "445", "SMB"),
      ("has_winrm", "5985/5986", "WinRM"), ("has_mssql", "1433", "MSSQL"),
      ("has_mysql", "3306", "MySQL"), ("has_postgresql", "5432", "PostgreSQL"),
      ("has_mongodb", "27017", "MongoDB"), ("has_redis", "6379", "Redis")]),
    ("Lateral Movement", "TA0008", "attacker moves through the network after initial compromise",
     [("has_smb", "445", "SMB"), ("has_rdp", "3389", "RDP"), ("has_winrm", "5985/5986", "WinRM"),
      ("has_rpcbind", "111", "RPC Bind"), ("has_netbios", "137/138/139", "NetBIOS"),
      ("has_ssh", "22", "SSH"), ("has_vnc", "5900", "VNC"),
      ("has_docker", "2375/2376", "Docker API"), ("has_kubernetes_api", "6443", "Kubernetes API")]),
    ("Reconnaissance", "T1046", "attacker probes services to map the network and gather intelligence",
     [("has_snmp", "161", "SNMP"), ("has_rpcbind", "111", "RPC Bind"),
      ("has_netbios", "137/138/139", "NetBIOS"), ("has_ldap", "389", "LDAP"),
      ("has_dns", "53", "DNS"), ("has_nfs", "2049", "NFS"), ("has_ftp", "21", "FTP"),
      ("has_telnet", "23", "Telnet"), ("has_elasticsearch", "9200", "Elasticsearch"),
      ("has_redis", "6379", "Redis"), ("has_mongodb", "27017", "MongoDB")]),
    ("Data Exfiltration", "TA0010", "attacker transfers data out through available unmonitored channels",
     [("has_ftp", "21", "FTP"), ("has_dns", "53", "DNS"), ("has_smtp", "25", "SMTP"),
      ("has_nfs", "2049", "NFS")]),
]

# Message and condition of dangerous service pairs, in order.
DANGEROUS_COMBOS = [
    ("SMB (445) + RDP (3389) both open — classic ransomware lateral movement path",
     "has_smb = 1 AND has_rdp = 1"),
    ("Telnet (23) + FTP (21) — two cleartext credential channels active simultaneously",
     "has_telnet = 1 AND has_ftp = 1"),
    ("RDP (3389) + VNC (5900) — two remote desktop services exposed, doubling brute-force risk",
     "has_rdp = 1 AND has_vnc = 1"),
    ("Redis (6379) + Docker API (2375/2376) — cache abuse can pivot directly into container takeover",
     "has_redis = 1 AND has_docker = 1"),
    ("Kubernetes API (6443) + database port — orchestration layer and data store both reachable",
     "has_kubernetes_api = 1 AND db_count > 0"),
    ("SMB (445) + NetBIOS (137-139) — full Windows file-sharing stack exposed to the network",
     "has_smb = 1 AND has_netbios = 1"),
    ("MongoDB (27017) + Elasticsearch (9200) — two data stores with historically weak default authentication",
     "has_mongodb = 1 AND has_elasticsearch = 1"),
    ("{db_count} database ports open simultaneously — multiple data stores directly reachable",
     "db_count >= 2"),
    ("Docker API + Kubernetes API both exposed — full container infrastructure accessible",
     "has_docker = 1 AND has_kubernetes_api = 1"),
    ("Telnet (23) + SMB (445) — cleartext access combined with a primary ransomware vector",
     "has_telnet = 1 AND has_smb = 1"),
]

# Message and condition of exposure patterns, in order.
EXPOSURE_PATTERNS = [
    ("{cleartext_count} cleartext protocol(s) active — authentication data transmitted without encryption",
     "cleartext_count >= 2"),
    ("{admin_port_count} administrative port(s) open — management attack surface is oversized",
     "admin_port_count >= 2"),
    ("{remote_access_count} remote access service(s) open — multiple lateral movement entry points",
     "remote_access_count >= 2"),
    ("{fileshare_count} file-sharing service(s) exposed — internal storage reachable from network",
     "fileshare_count >= 2"),
    ("{uncommon_open_count} non-standard port(s) open — possible backdoors or undocumented services",
     "uncommon_open_count >= 3"),
]

# Pattern id, name, severity, minimum hosts, host condition, description,
# technique text, recommendation; "{n}" is the number of hosts.
NETWORK_PATTERNS = [
    ("lateral_movement_campaign", "Lateral Movement Campaign", "CRITICAL", 2,
     "has_smb = 1 AND has_rdp = 1",
     "{n} hosts expose both SMB (445) and RDP (3389) simultaneously — the ransomware lateral movement pathway is active at network scale",
     "TA0008 Lateral Movement, T1021.002 SMB/Windows Admin Shares",
     "Segment the network, block direct SMB/RDP between hosts, enforce MFA on all remote access endpoints"),
    ("smb_worm_propagation_conditions", "SMB Worm Propagation Conditions", "CRITICAL", 3,
     "has_smb = 1",
     "{n} hosts expose SMB (445) — sufficient density for autonomous worm self-propagation (EternalBlue / WannaCry-style spread)",
     "T1210 Exploitation of Remote Services, TA0008 Lateral Movement",
     "Apply MS17-010 patches, disable SMBv1, restrict SMB to storage servers only and block it between workstations"),
    ("cleartext_credential_spray_surface", "Cleartext Credential Spray Surface", "HIGH", 2,
     "has_telnet = 1 OR has_ftp = 1",
     "{n} hosts expose Telnet or FTP — credentials are transmitted in plaintext, enabling passive network-wide credential harvesting",
     "T1110 Brute Force, T1040 Network Sniffing",
     "Disable Telnet and FTP across the entire network segment, replace with SSH and SFTP/FTPS"),
    ("database_exposure_cluster", "Database Exposure Cluster", "HIGH", 3,
     "db_count >= 1",
     "{n} hosts expose database listener ports — an attacker can enumerate, dump, or ransom multiple databases in a single campaign",
     "T1213 Data from Information Repositories, TA0010 Exfiltration",
     "Move all database ports behind application-layer firewalls, disable public listener interfaces"),
    ("container_orchestration_api_cluster", "Container / Orchestration API Cluster", "CRITICAL", 2,
     "has_docker = 1 OR has_kubernetes_api = 1",
     "{n} hosts expose Docker API or Kubernetes API — unauthenticated access allows full container escape and cluster-level takeover",
     "T1611 Escape to Host, TA0004 Privilege Escalation",
     "Bind Docker API to Unix socket only, enable Kubernetes RBAC and mutual TLS, never expose these APIs on network interfaces"),
    ("remote_access_vector_cluster", "Remote Access Vector Cluster", "HIGH", 3,
     "remote_access_count >= 2",
     "{n} hosts each expose multiple remote access protocols (SSH, RDP, VNC, WinRM) — broad credential brute-force surface across the network",
     "T1110 Brute Force, T1021 Remote Services",
     "Consolidate remote access through a single VPN gateway or bastion host, disable unused remote protocols"),
    ("critical_host_mass_detected", "Critical Severity Host Mass", "HIGH", 3,
     "severity = 'CRITICAL'",
     "{n} hosts are classified CRITICAL — this scale suggests either a severely misconfigured network segment or an active compromise in progress",
     None,
     "Initiate immediate incident response triage — isolate the highest-risk hosts and begin forensic investigation"),
]

# Unknown-port guesses.
APPLE_TOKENS = ["mac", "macbook", "mbp", "imac", "iphone", "ipad", "apple", "airtunes", "airplay", "eppc"]
APPLE_PORTS = [3031]
APPLE_SERVICES = ["eppc"]
MEDIA_TOKENS = ["rtsp", "airtunes", "airplay", "upnp", "camera", "camstream"]
PRINTER_TOKENS = ["printer", "cups", "ipp"]
PRINTER_PORTS = [631]
UNKNOWN_SERVICE_NAMES = ["", "unknown"]
GUESS_CONFIDENCE = {
    "none": 0.15, "ephemeral": 0.35, "apple_dynamic": 0.70, "apple_media": 0.65,
    "media_port": 0.60, "media_dynamic": 0.50, "printer": 0.55, "web_admin": 0.30, "max": 0.95,
}
GUESS_SERVICE = {
    "none": "unknown-service", "ephemeral": "ephemeral-local-service",
    "apple_dynamic": "macos-dynamic-service", "apple_media": "apple-continuity",
    "media_port": "media-streaming-service", "media_dynamic": "media-device-dynamic-service",
    "printer": "printer-related-service",
}
GUESS_DEVICE = {
    "none": "unknown device", "apple": "Apple/macOS device", "media": "camera/IoT/media device",
    "printer": "printer", "web_admin": "network appliance or web-managed device",
}
GUESS_EVIDENCE = {
    "ephemeral": "port is in the dynamic/private range 49152-65535",
    "apple": "host has Apple/macOS indicators from hostname, services, or scripts",
    "media": "neighboring services or scripts include RTSP, AirTunes, UPnP, or camera-like signals",
    "printer": "host has printer or IPP/CUPS indicators",
    "web_admin": "host exposes common web or admin ports",
    "none": "Nmap confirmed the port is open but did not return service metadata",
}

# Origin names of a service.
SOURCE_SCAN = "nmap"
SOURCE_ENRICHED = "nmap_enriched"
SOURCE_GUESS = "guess"

# Script summary shape.
SCRIPT_LIMIT = 3
SCRIPT_MAX_LENGTH = 140

# Training settings.
MIN_TRAIN_ROWS = 2
MIN_ROWS_FOR_LINEAR = 4
SMALL_SET_ROWS = 3
TEST_SHARE_SMALL = 0.5
TEST_SHARE = 0.3
MIN_CLASS_ROWS_TO_STRATIFY = 2
TREE_MAX_DEPTH = 6
LINEAR_MAX_ITER = 2000
SEED = 42
FOREST_TREES = 100
FOREST_SAMPLE = 256
NOTE_NO_LABEL = "Training CSV must contain a label column.\n"
NOTE_FEW_ROWS = "Not enough samples to train machine learning models.\n"
NOTE_ONE_CLASS = "Training data contains only one class, so machine learning training was skipped.\n"
NOTE_ONE_CLASS_SPLIT = "Training split contains only one class, so machine learning training was skipped.\n"
NOTE_ALL_FAILED = "All machine learning models failed during training.\n"
