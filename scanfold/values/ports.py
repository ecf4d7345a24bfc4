"""Port profiles, service aliases and port groups.

The rows below are data that results depend on; they are kept as plain text in
their natural order.
"""

# Port, name, category, risk level, description, recommendation.
PORT_PROFILES = [
    (20, "ftp-data", "file_transfer", "medium", "FTP data channel can expose file transfers.", "Disable FTP when possible or restrict it to trusted networks."),
    (21, "ftp", "file_transfer", "high", "Plain FTP often sends credentials and data without encryption.", "Replace FTP with SFTP/FTPS or restrict access behind VPN."),
    (22, "ssh", "remote_access", "medium", "SSH is secure when patched, key-based, and not publicly exposed unnecessarily.", "Use keys, disable password login where possible, and restrict source IPs."),
    (23, "telnet", "remote_access", "critical", "Telnet sends credentials in clear text and is unsafe on modern networks.", "Disable Telnet and replace it with SSH."),
    (25, "smtp", "mail", "medium", "SMTP can be abused for relay or mail-system probing.", "Require authentication, disable open relay, and restrict administration access."),
    (53, "dns", "dns", "medium", "DNS exposure can leak internal names or support amplification if misconfigured.", "Restrict recursion and expose only required DNS services."),
    (69, "tftp", "file_transfer", "high", "TFTP has no authentication and is commonly abused for device config theft.", "Disable TFTP unless required and isolate it to a management VLAN."),
    (80, "http", "web", "low", "HTTP is unencrypted and may expose web admin panels or application metadata.", "Redirect to HTTPS and protect admin paths."),
    (110, "pop3", "mail", "medium", "POP3 can expose mail credentials when not wrapped in TLS.", "Prefer POP3S or modern authenticated mail access."),
    (111, "rpcbind", "rpc", "high", "RPC bind exposes service mapping and often supports lateral movement.", "Restrict RPC services to trusted hosts."),
    (135, "msrpc", "windows_rpc", "high", "Windows RPC exposure increases attack surface for enumeration and lateral movement.", "Block from untrusted networks and patch Windows services."),
    (137, "netbios-ns", "fileshare", "high", "NetBIOS name service leaks Windows host and domain information.", "Disable NetBIOS where possible or restrict to trusted LANs."),
    (138, "netbios-dgm", "fileshare", "high", "NetBIOS datagram service expands legacy Windows exposure.", "Disable NetBIOS where possible or restrict to trusted LANs."),
    (139, "netbios-ssn", "fileshare", "high", "NetBIOS session service exposes legacy file-sharing paths.", "Disable legacy SMB/NetBIOS or restrict to trusted LANs."),
    (143, "imap", "mail", "medium", "IMAP can expose mailbox access when not protected by TLS.", "Prefer IMAPS and enforce strong authentication."),
    (161, "snmp", "management", "high", "SNMP can leak device inventory, interfaces, and secrets when community strings are weak.", "Use SNMPv3 and restrict polling hosts."),
    (389, "ldap", "directory", "medium", "LDAP can expose directory data and authentication surfaces.", "Require TLS/signing and restrict anonymous binds."),
    (443, "https", "web", "low", "HTTPS is expected for web services but may still expose admin panels.", "Keep TLS and web software patched."),
    (445, "smb", "fileshare", "critical", "SMB is a high-value lateral movement and ransomware target.", "Restrict SMB to trusted subnets and disable SMBv1."),
    (465, "smtps", "mail", "low", "SMTPS is encrypted but still exposes mail infrastructure.", "Patch mail services and require authentication."),
    (514, "syslog", "logging", "medium", "Syslog can leak infrastructure data or accept forged logs.", "Restrict log ingestion to known senders."),
    (554, "rtsp", "iot_media", "medium", "RTSP often appears on cameras and media devices with weak credentials.", "Change defaults and isolate cameras or media devices."),
    (587, "submission", "mail", "low", "Mail submission should require authentication and TLS.", "Require TLS and disable unauthenticated relay."),
    (631, "ipp", "printer", "medium", "Printer services can expose device management and document metadata.", "Restrict printer access and disable web admin from untrusted networks."),
    (993, "imaps", "mail", "low", "IMAPS is encrypted but still exposes mailbox access.", "Patch mail services and enforce MFA where possible."),
    (995, "pop3s", "mail", "low", "POP3S is encrypted but still exposes mailbox access.", "Patch mail services and enforce strong authentication."),
    (1433, "mssql", "database", "critical", "Microsoft SQL Server should rarely be exposed broadly.", "Restrict SQL Server to application hosts and require strong authentication."),
    (1521, "oracle", "database", "critical", "Oracle database listener exposure can reveal database services.", "Restrict database listener access to trusted application hosts."),
    (1723, "pptp", "vpn", "high", "PPTP is considered weak and should be replaced.", "Replace PPTP with a modern VPN protocol."),
    (1883, "mqtt", "iot_messaging", "high", "MQTT often controls IoT devices and may allow unauthenticated publish/subscribe.", "Require authentication, TLS, and topic ACLs."),
    (2049, "nfs", "fileshare", "high", "NFS can expose file systems when exports are too broad.", "Restrict exports and require trusted clients."),
    (2375, "docker", "container_admin", "critical", "Unauthenticated Docker API exposure can lead to host takeover.", "Disable public Docker API or require TLS client certificates."),
    (2376, "docker-tls", "container_admin", "high", "Docker API is highly sensitive even when TLS is enabled.", "Restrict Docker API to trusted automation hosts."),
    (27017, "mongodb", "database", "critical", "MongoDB exposure can leak databases when authentication is weak.", "Bind to private interfaces and enforce authentication."),
    (3306, "mysql", "database", "critical", "MySQL should not be broadly exposed outside trusted app networks.", "Restrict MySQL to application hosts and require strong credentials."),
    (3389, "rdp", "remote_access", "critical", "RDP is a common brute-force and lateral movement target.", "Restrict RDP with VPN, MFA, and account lockout."),
    (5000, "upnp/rtsp/web", "iot_media", "medium", "Port 5000 is commonly used by device admin, RTSP, or dev services.", "Verify the owning process and restrict access if not required."),
    (5432, "postgresql", "database", "critical", "PostgreSQL should not be broadly exposed outside trusted app networks.", "Restrict PostgreSQL to application hosts and require strong credentials."),
    (5601, "kibana", "admin_console", "high", "Kibana can expose logs, dashboards, and sensitive operational data.", "Require SSO/authentication and restrict to admin networks."),
    (5900, "vnc", "remote_access", "critical", "VNC often lacks strong authentication and exposes desktop access.", "Disable VNC or restrict it through VPN with strong authentication."),
    (5985, "winrm", "windows_admin", "high", "WinRM exposes Windows remote administration.", "Restrict WinRM to management hosts and require secure authentication."),
    (5986, "winrm-https", "windows_admin", "high", "WinRM over HTTPS still exposes Windows remote administration.", "Restrict WinRM to management hosts and monitor usage."),
    (6379, "redis", "database", "critical", "Redis exposure can lead to data theft or remote command abuse when unauthenticated.", "Bind Redis privately and require authentication."),
    (6443, "kubernetes-api", "container_admin", "critical", "Kubernetes API exposure is highly sensitive.", "Restrict API access and enforce strong RBAC."),
    (8080, "http-alt", "web", "medium", "Alternate HTTP ports often host admin panels, proxies, or dev apps.", "Identify the application and protect admin access."),
    (8443, "https-alt", "web", "medium", "Alternate HTTPS ports often host admin panels or device consoles.", "Identify the application and protect admin access."),
    (9000, "admin/web", "admin_console", "high", "Port 9000 often hosts admin consoles or developer services.", "Verify the service and restrict it if not public-facing."),
    (9200, "elasticsearch", "database", "critical", "Elasticsearch exposure can leak indexed data and cluster metadata.", "Restrict Elasticsearch and require authentication."),
    (11211, "memcached", "cache", "high", "Memcached exposure can leak cached data and support amplification attacks.", "Bind Memcached privately and block UDP/TCP from untrusted networks."),
    (27015, "game/server", "gaming", "low", "Game or custom service ports are usually low risk but should be verified.", "Confirm the owning service and close it if unused."),
]

# Text used for a port without a profile.
UNPROFILED_CATEGORY = "other"
UNPROFILED_RISK = "low"
UNPROFILED_DESCRIPTION = "No specific high-risk profile is known for this port."
UNPROFILED_RECOMMENDATION = "Verify the owning service and close the port if it is not required."

# Numeric score per risk level.
RISK_SCORES = {"low": 1, "medium": 2, "high": 3, "critical": 4}

# Service token and its first category, in match order.
SERVICE_TOKENS = [
    ("ftp", "file_transfer"),
    ("ssh", "remote_access"),
    ("telnet", "remote_access"),
    ("smtp", "mail"),
    ("imap", "mail"),
    ("pop", "mail"),
    ("http", "web"),
    ("ssl", "encrypted"),
    ("https", "web"),
    ("smb", "fileshare"),
    ("microsoft-ds", "fileshare"),
    ("netbios", "fileshare"),
    ("nfs", "fileshare"),
    ("rpc", "rpc"),
    ("mysql", "database"),
    ("postgres", "database"),
    ("mssql", "database"),
    ("oracle", "database"),
    ("redis", "database"),
    ("mongodb", "database"),
    ("elasticsearch", "database"),
    ("rdp", "remote_access"),
    ("vnc", "remote_access"),
    ("snmp", "management"),
    ("ldap", "directory"),
    ("mqtt", "iot_messaging"),
    ("rtsp", "iot_media"),
    ("ipp", "printer"),
    ("docker", "container_admin"),
    ("kubernetes", "container_admin"),
    ("winrm", "windows_admin"),
]

# Fixed value: the one service token that marks a cleartext service.
CLEARTEXT_TOKEN = "telnet"

# Port groups.
PORT_GROUPS = {
    "risky": [21, 22, 23, 25, 53, 69, 80, 110, 111, 135, 137, 138, 139, 143, 161, 389, 443, 445,
              465, 514, 554, 587, 631, 993, 995, 1433, 1521, 1723, 1883, 2049, 2375, 2376, 27017,
              3306, 3389, 5000, 5432, 5601, 5900, 5985, 5986, 6379, 6443, 8080, 8443, 9000, 9200,
              11211],
    "very_risky": [21, 23, 69, 111, 135, 137, 138, 139, 161, 445, 1433, 1521, 1883, 2049, 2375,
                   27017, 3306, 3389, 5432, 5900, 6379, 6443, 9200, 11211],
    "web": [80, 443, 5000, 5601, 8080, 8443, 9000],
    "remote_access": [21, 22, 23, 3389, 5900, 5985, 5986],
    "mail": [25, 110, 143, 465, 587, 993, 995],
    "db": [1433, 1521, 27017, 3306, 5432, 6379, 9200],
    "fileshare": [111, 137, 138, 139, 445, 2049],
    "media": [554, 5000, 7000],
    "cleartext": [20, 21, 23, 25, 69, 80, 110, 143, 161, 389, 514, 1883],
    "admin": [22, 23, 135, 161, 445, 2375, 2376, 3389, 5601, 5900, 5985, 5986, 6443, 8080, 8443,
              9000],
    "iot": [554, 631, 1883, 5000],
    "encrypted": [443, 465, 993, 995, 8443, 5986],
    "common_high": [1433, 1521, 1883, 2049, 2375, 2376, 27017, 3306, 3389, 5432, 5601, 5900, 5985,
                    5986, 6379, 6443, 8080, 8443, 9000, 9200, 11211],
}

# Host flag and the ports that set it, in feature order.
HOST_FLAGS = [
    ("has_ftp", [21]), ("has_ssh", [22]), ("has_telnet", [23]), ("has_smtp", [25]),
    ("has_dns", [53]), ("has_tftp", [69]), ("has_http", [80]), ("has_pop3", [110]),
    ("has_rpcbind", [111]), ("has_netbios", [137, 138, 139]), ("has_imap", [143]),
    ("has_snmp", [161]), ("has_ldap", [389]), ("has_https", [443]), ("has_smb", [445]),
    ("has_rtsp", [554]), ("has_printer", [631]), ("has_mssql", [1433]), ("has_oracle", [1521]),
    ("has_mqtt", [1883]), ("has_nfs", [2049]), ("has_docker", [2375, 2376]),
    ("has_mongodb", [27017]), ("has_mysql", [3306]), ("has_rdp", [3389]),
    ("has_postgresql", [5432]), ("has_kibana", [5601]), ("has_vnc", [5900]),
    ("has_winrm", [5985, 5986]), ("has_redis", [6379]), ("has_kubernetes_api", [6443]),
    ("has_elasticsearch", [9200]), ("has_memcached", [11211]), ("has_http_alt", [8080, 8443]),
]

# Service bucket and the substrings that select it, in match order.
SERVICE_BUCKETS = [
    ("web", ["http"]),
    ("remote", ["ssh", "telnet", "ftp", "rdp", "vnc", "winrm"]),
    ("mail", ["smtp", "imap", "pop"]),
    ("database", ["mysql", "postgres", "mssql", "oracle", "redis", "mongo", "elastic"]),
    ("fileshare", ["smb", "microsoft-ds", "netbios", "nfs", "rpcbind"]),
    ("dns", ["domain", "dns"]),
    ("management", ["snmp"]),
    ("iot", ["rtsp", "mqtt", "ipp"]),
]
OTHER_BUCKET = "other"

# Profile categories counted per host.
COUNTED_CATEGORIES = ["remote_access", "database", "fileshare", "admin_console", "container_admin"]

# Port range limits.
UNCOMMON_PORT_MIN = 1024
EPHEMERAL_PORT_MIN = 49152
