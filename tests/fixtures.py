"""Static host tables with known results."""

from scanfold import schemas

# Number, service, product and version of each port.
SERVICES = {
    "web": [(80, "http", "Apache", "2.4"), (443, "https", "Apache", "2.4")],
    "ssh_https": [(22, "ssh", "OpenSSH", "9.0"), (443, "https", "nginx", "1.24")],
    "ssh": [(22, "ssh", "OpenSSH", "8.9")],
    "gaming": [(27015, "unknown", "", ""), (443, "https", "nginx", "1.24")],
    "printer": [(80, "http", "Printer-Web", "3.2"), (631, "ipp", "CUPS", "2.4")],
    "camera": [(80, "http", "Cam-Web", "1.8"), (554, "rtsp", "CamStream", "2.0")],
    "pos": [(443, "https", "POS-Web", "5.1"), (3306, "mysql", "MySQL", "8.0")],
    "nas": [(22, "ssh", "OpenSSH", "9.0"), (445, "microsoft-ds", "Samba", "4.15"), (2049, "nfs", "", "")],
    "wifi": [(22, "ssh", "OpenSSH", "9.1"), (443, "https", "nginx", "1.24"), (8080, "http-proxy", "", "")],
    "admin": [(22, "ssh", "OpenSSH", "9.0"), (443, "https", "nginx", "1.24"), (445, "microsoft-ds", "Samba", "4.15"), (3306, "mysql", "MySQL", "8.0"), (3389, "ms-wbt-server", "", "")],
}
# Ports of the risky hosts by last address part.
RISKY = {
    201: [21, 23, 3000, 5000], 202: [23, 111, 445, 7000], 203: [21, 23, 445, 3389, 8081],
    204: [23, 445, 3389, 5900, 7001], 205: [21, 23, 111, 445, 3389], 206: [23, 445, 3389, 5000, 5001],
    207: [21, 23, 445, 3389, 6379], 208: [23, 111, 445, 3389, 5900], 209: [21, 23, 445, 3389, 8080],
    210: [23, 445, 3306, 3389, 7000], 220: [21, 53, 443, 8088, 9001],
}
NAMES = {21: "ftp", 23: "telnet", 53: "domain", 111: "rpcbind", 443: "https", 445: "microsoft-ds",
         3306: "mysql", 3389: "ms-wbt-server", 5000: "rtsp", 5900: "vnc", 6379: "redis", 8080: "http-proxy"}


def port(number, service, product="", version="", tunnel="", protocol="tcp", scripts=()):
    return {"protocol": protocol, "port": number, "service": service, "service_source": "nmap",
            "product": product, "version": version, "extrainfo": "", "service_method": "",
            "service_confidence": "", "service_ostype": "", "tunnel": tunnel, "state_reason": "",
            "scripts": [{"id": i, "output": o} for i, o in scripts]}


def host(ip, name, ports, scan_id="s1", vendor="", systems=()):
    return {"scan_id": scan_id, "ip": ip, "hostname": name, "mac": "", "vendor": vendor,
            "os_matches": [{"name": n, "accuracy": "96"} for n in systems], "open_ports": ports}


def _kind(name):
    return [port(*row) for row in SERVICES[name]]


def cafe_hosts():
    """60 hosts with 149 open ports."""
    hosts = []
    for i in range(1, 41):
        kinds = ["gaming", "web", "ssh_https", "ssh"][i % 4] if i <= 30 else ["camera", "web", "printer"][i % 3]
        hosts.append(host(f"10.10.0.{i}", f"client-pc-{i:02d}", _kind(kinds)))
    for part, kind in ((101, "printer"), (102, "printer"), (110, "camera"), (111, "camera"), (120, "pos"),
                       (121, "pos"), (130, "nas"), (140, "wifi"), (250, "admin")):
        hosts.append(host(f"10.10.0.{part}", f"{kind}-{part}", _kind(kind)))
    for part, ports in RISKY.items():
        hosts.append(host(f"10.10.0.{part}", f"risky-{part}",
                          [port(n, NAMES.get(n, "unknown")) for n in ports]))
    return hosts


# Ip, ports, score, label, confidence, asset, alerts by severity.
SYNTHETIC = [
    ("10.10.10.10", [22, 443], 0, "normal", 1.0, "server", (0, 0, 0, 1)),
    ("10.10.10.11", [62078, 49152], 0, "normal", 1.0, "unknown", (0, 0, 0, 0)),
    ("10.10.10.12", [631, 9100], 0, "normal", 1.0, "printer", (0, 0, 0, 1)),
    ("10.10.10.13", [80, 443], 0, "normal", 1.0, "server", (0, 0, 0, 1)),
    ("10.10.10.14", [25, 587, 993], 0, "normal", 1.0, "mail_server", (0, 0, 0, 1)),
    ("10.10.10.15", [22, 8080], 2, "normal", 0.8, "server", (0, 1, 0, 1)),
    ("10.10.10.16", [554, 80], 0, "normal", 1.0, "iot_camera", (0, 0, 0, 2)),
    ("10.10.10.17", [22, 5000, 7000], 0, "normal", 1.0, "server", (0, 0, 0, 1)),
    ("10.10.10.18", [53, 443], 0, "normal", 1.0, "unknown", (0, 0, 0, 1)),
    ("10.10.10.19", [22, 443, 2049], 0, "normal", 1.0, "server", (0, 0, 0, 1)),
    ("10.10.20.20", [23, 80, 161], 12, "suspicious", 1.0, "network_device", (1, 3, 0, 1)),
    ("10.10.20.21", [21, 445, 139], 12, "suspicious", 1.0, "file_server", (1, 1, 0, 0)),
    ("10.10.20.22", [3389, 5985, 445], 13, "suspicious", 1.0, "workstation", (2, 3, 0, 0)),
    ("10.10.20.23", [3306, 5432, 6379], 10, "suspicious", 1.0, "database_server", (2, 0, 0, 0)),
    ("10.10.20.24", [2375, 6443, 10250], 12, "suspicious", 1.0, "container_host", (2, 1, 0, 0)),
    ("10.10.20.25", [9200, 5601, 9300], 5, "suspicious", 0.5, "unknown", (1, 0, 0, 0)),
    ("10.10.20.26", [1883, 554, 23], 10, "suspicious", 1.0, "iot_camera", (1, 2, 0, 1)),
    ("10.10.20.27", [69, 111, 2049], 10, "suspicious", 1.0, "file_server", (0, 3, 0, 0)),
    ("10.10.20.28", [5900, 22, 8080], 8, "suspicious", 0.8, "server", (1, 2, 0, 1)),
    ("10.10.20.29", [11211, 6379, 80], 8, "suspicious", 0.8, "server", (1, 1, 0, 1)),
]
SYNTHETIC_SERVICES = {62078: "iphone-sync", 9100: "jetdirect", 7000: "airplay", 10250: "kubelet",
                      9300: "elasticsearch-node", 49152: "unknown"}


def synthetic_hosts():
    from scanfold.values.ports import PORT_PROFILES
    names = {row[0]: row[1] for row in PORT_PROFILES} | SYNTHETIC_SERVICES
    return [host(ip, f"host-{ip}", [port(p, names[p]) for p in ports])
            for ip, ports, *_ in SYNTHETIC]


def host_frame(spark, hosts):
    return spark.createDataFrame(hosts, schemas.HOST)
