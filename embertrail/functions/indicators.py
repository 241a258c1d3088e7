"""Fixed values of the field transforms: labels with the patterns that set them, and word lists.

Each entry is (label, pattern). A pattern is matched without regard to case. All of this must equal what the rules
expect, so it stands here as plain text, in the order in which labels are reported.
"""

# --- label tables: output column -> (most labels, entries) -------------------------------------------------------
LABELS: dict[str, tuple[int | None, list[tuple[str, str]]]] = {
    "CommandLine_AMSIBypass": (None, [
        ("AMSI_REF", r"amsi"), ("AMSI_INIT_FAILED", r"amsiInitFailed"), ("AMSI_CONTEXT", r"amsiContext"),
        ("AMSI_SCAN_BUFFER", r"AmsiScanBuffer"), ("AMSI_REFLECTION", r"\[Ref\]\.Assembly\.GetType.*AMSI"), ("AMSI_DLL", r"amsi\.dll"),
    ]),
    "CommandLine_DownloadCradle": (None, [
        ("DOWNLOADSTRING", r"downloadstring"), ("DOWNLOADFILE", r"downloadfile"), ("DOWNLOADDATA", r"downloaddata"),
        ("INVOKE_WEBREQUEST", r"invoke-webrequest|iwr"), ("INVOKE_RESTMETHOD", r"invoke-restmethod|irm"), ("WEBCLIENT", r"webclient"),
        ("BITSTRANSFER", r"bitstransfer"), ("CERTUTIL_DOWNLOAD", r"certutil.*-urlcache"), ("BITSADMIN_DOWNLOAD", r"bitsadmin.*/transfer"),
        ("CURL_WGET", r"\b(curl|wget)\b"),
    ]),
    "CommandLine_EvasionTechniques": (None, [
        ("PROCESS_HOLLOWING", r"ntunmapviewofsection|zwunmapviewofsection"), ("REFLECTIVE_DLL", r"reflectiveloader"),
        ("TOKEN_MANIPULATION", r"adjusttokenprivileges|setthreadtoken"), ("MEMORY_ALLOC", r"virtualalloc|ntalloc|zwalloc"),
        ("REMOTE_THREAD", r"createremotethread"), ("SYSCALL", r"\bsyscall\b|ntdll"), ("ETW_BYPASS", r"etw|nttracevent"),
    ]),
    "CommandLine_LateralMovement": (3, [
        ("LATERAL:PSEXEC", r"psexec|paexec"), ("LATERAL:REMOTE_SERVICE", r"sc\s+\\\\[^\s]+\s+(create|start|config|query)"),
        ("LATERAL:WMI", r"wmic\s+/node:|invoke-wmimethod|invoke-cimmethod"), ("LATERAL:WINRM", r"enter-pssession|invoke-command\s+.*-computername|winrs\s+"),
        ("LATERAL:RDP", r"mstsc\s+/v:|cmdkey\s+/add:"), ("LATERAL:SMB", r"(net\s+use|copy|move|xcopy|robocopy)\s+\\\\"),
        ("LATERAL:SSH", r"\bssh\s+.*@|\bscp\s+.*:|plink\s+"), ("LATERAL:DCOM", r"mmc20\.application|shellwindows|shellbrowserwindow"),
        ("LATERAL:AT_REMOTE", r"\bat\s+\\\\"),
    ]),
    "CommandLine_DataStaging": (3, [
        ("STAGING:ARCHIVE", r"\brar\s+a\b|7z\s+a\b|\bzip\b.*-r|tar\s+(-czf|-cf|--create)|makecab|compact\s+/c"),
        ("STAGING:BULK_COPY", r"\brobocopy\b|\bxcopy\b.*(/s|/e)|\bcopy\b.*\*\."), ("STAGING:DB_DUMP", r"sqlcmd\s+.*-q|mysqldump|pg_dump|sqlite3\s+.*\.dump"),
        ("STAGING:EMAIL_COLLECT", r"\.(pst|ost)\b"), ("STAGING:FILE_HUNT", r"(findstr|dir|find|ls|get-childitem).*\.(docx?|xlsx?|pptx?|pdf|kdbx|key|pem)"),
        ("STAGING:AD_DUMP", r"ntdsutil|secretsdump|dcsync"),
    ]),
    "CommandLine_C2Indicators": (3, [
        ("C2:COBALT_STRIKE", r"\bbeacon\b|\bspawn(to|as|x64|x86)\b|\\\\\.\\pipe\\msagent_|\\\\\.\\pipe\\postex_|/pixel[^a-z]|/submit\.php|/__utm\.gif|/activity|jump\s+(psexec|winrm|ssh)"),
        ("C2:METASPLOIT", r"meterpreter|multi/handler|exploit/|payload/|msfvenom|msfconsole|lhost\s*=|lport\s*="), ("C2:SLIVER", r"\bsliver\b|implant.*generate|mtls\s|wg\s.*listener"),
        ("C2:EMPIRE", r"\blauncher\b.*\bstager\b|invoke-empire|starfighters|starkiller"), ("C2:HAVOC", r"\bdemon\b.*\bhavoc\b|havoc\s+.*listener"),
        ("C2:GENERIC_PIPE", r"\\\\\.\\pipe\\[a-f0-9]{8}-[a-f0-9]{4}"), ("C2:COVENANT", r"\bgrunt\b.*\bcovenant\b|grunt(http|smb)"),
    ]),
    "CommandLine_PersistenceCategory": (3, [
        ("PERSIST:SCHED_TASK", r"schtasks\s+/create|new-scheduledtask|register-scheduledjob"), ("PERSIST:SERVICE", r"sc\s+(create|config)\s|new-service\s|sc\.exe\s+(create|config)"),
        ("PERSIST:REG_RUN", r"(reg\s+add|set-itemproperty|new-itemproperty).*\\(run|runonce)\b"), ("PERSIST:WMI_SUB", r"__eventfilter|commandlineeventconsumer|__filtertoconsumerbinding|set-wmiinstance"),
        ("PERSIST:STARTUP_FOLDER", r"shell:startup|start menu\\programs\\startup|\.lnk.*startup"), ("PERSIST:DLL_SEARCH", r"(reg\s+add|set-itemproperty).*\\environment\\.*path"),
        ("PERSIST:CRON", r"crontab\s+-[ei]|/etc/cron\.|/var/spool/cron"), ("PERSIST:SYSTEMD", r"systemctl\s+(enable|daemon-reload)|/etc/systemd/"),
        ("PERSIST:LAUNCH_AGENT", r"launchagent|launchdaemon|com\.apple\.loginitems|/library/launch"), ("PERSIST:BOOT", r"bcdedit\s+/set|bootexecute"),
    ]),
    "CommandLine_ReconIndicators": (3, [
        ("RECON:SYSINFO", r"\bsysteminfo\b|\bhostname\b|\bver\b$|\buname\s+-a\b"),
        ("RECON:NETWORK", r"\bipconfig\b|\bifconfig\b|\bnetstat\b|\barp\s+-a\b|\broute\s+print\b|\bnslookup\b|\btracert\b|\btraceroute\b"),
        ("RECON:USER_ENUM", r"\bwhoami\b|\bnet\s+user\b|\bnet\s+group\b|\bnet\s+localgroup\b|\b(id|groups)\s"),
        ("RECON:DOMAIN", r"nltest\s+/dclist|dsquery|gpresult|adfind|ldapsearch|get-addomain|get-adforest"), ("RECON:SHARE", r"\bnet\s+share\b|\bnet\s+view\b"),
        ("RECON:PROCESS", r"\btasklist\b|wmic\s+process|get-process\b|\bps\s+aux\b"), ("RECON:SECURITY", r"netsh\s+advfirewall|get-mppreference|wmic.*antivirusproduct|get-mpcomputerstatus"),
    ]),
    "CommandLine_InjectionTechnique": (3, [
        ("INJECT:CLASSIC", r"createremotethread|ntcreatethread"), ("INJECT:ALLOC_WRITE", r"(?s)(?=.*virtualallocex)(?=.*writeprocessmemory)"),
        ("INJECT:HOLLOWING", r"create_suspended|ntunmapviewofsection|zwunmapviewofsection"), ("INJECT:APC", r"queueuserapc|ntqueueapcthread"),
        ("INJECT:THREAD_HIJACK", r"suspendthread.*setthreadcontext|getthreadcontext.*setthreadcontext"), ("INJECT:CALLBACK", r"enumwindows|createtimerqueuetimer|setwindowshookex"),
        ("INJECT:MAPPING", r"ntcreatesection.*ntmapviewofsection"), ("INJECT:ETW_BYPASS", r"ntwritevirtualmemory.*etweventwrite|etweventwrite.*patch"),
        ("INJECT:SHELLCODE_ALLOC", r"virtualalloc.*marshal\.copy|virtualalloc.*\[byte\[\]\]"),
    ]),
    "Image_PathAnomaly": (3, [
        ("TEMP_DIR", r"/temp/"), ("WINDOWS_TEMP", r"/windows/temp/"), ("USER_TEMP", r"/appdata/local/temp/"), ("APPDATA", r"(?s)^(?!.*/appdata/local/temp/).*/appdata/"),
        ("DOWNLOADS", r"/users/[^/]+/downloads/"), ("USER_DESKTOP", r"/users/[^/]+/desktop/"), ("USER_MEDIA_DIR", r"/users/[^/]+/(music|videos|pictures)/"),
        ("RECYCLE_BIN", r"\$recycle\.bin|recycler"), ("PUBLIC_PROFILE", r"/users/public/"), ("PERFLOGS", r"/perflogs/"),
    ]),
    "Image_StagingDirectory": (3, [
        ("STAGING:ProgramData", r"/programdata/"), ("STAGING:WindowsTemp", r"/windows/temp/"), ("STAGING:RootTemp", r"^[a-z]:/temp/"), ("STAGING:PerfLogs", r"/perflogs/"),
        ("STAGING:VendorFolder", r"(?s)^(?!.*/program files).*/(intel|dell|hp|lenovo|nvidia)/"), ("STAGING:PublicProfile", r"/users/public/"), ("STAGING:RecycleBin", r"\$recycle\.bin"),
        ("STAGING:UNC_Path", r"^//"), ("STAGING:LinuxTmp", r"^(/tmp/|/var/tmp/)"), ("STAGING:DevShm", r"^/dev/shm/"),
    ]),
    "ScriptBlockText_ReflectionAbuse": (None, [
        ("ASSEMBLY_LOAD", r"system\.reflection\.assembly"), ("DYNAMIC_LOAD", r"(?s)(?=.*load\()(?=.*assembly)"), ("TYPE_REFLECTION", r"\[type\]|gettype\("),
        ("INVOKE_METHOD", r"\.invoke\(|invokemember\("), ("GET_MEMBER", r"getmethod\(|getfield\(|getproperty\("),
        ("DELEGATE_CREATION", r"getdelegateforcunctionpointer|marshal\.getdelegateforfunctionpointer"),
    ]),
    "ScriptBlockText_ShellcodeIndicators": (None, [
        ("EXEC_MEMORY_ALLOC", r"virtualalloc.*0x40|virtualalloc.*page_execute"), ("KERNEL32_REF", r"kernel32"), ("NTDLL_REF", r"ntdll"), ("CREATE_THREAD", r"createthread"),
        ("NOP_SLED", r"(?-i:0x90,\s*0x90|\\x90\\x90)"), ("MEMORY_COPY", r"marshal\.copy|rtlmovememory|copymemory"), ("POINTER_OP", r"intptr|marshal\.allochglobal"),
    ]),
    "ScriptBlockText_ObfuscationIndicators": (None, [
        ("CHAR_SUBST", r"`[a-z]"), ("STR_CONCAT", r"'[^']+'\s*\+\s*'[^']+'"), ("JOIN_OP", r"-join"), ("FORMAT_STR", r"-f\s*['\"]"), ("VAR_SUBST", r"\$\{[^}]+\}"),
        ("ENC_CMD", r"-enc"), ("GZIPSTREAM", r"gzipstream"), ("FROMBASE64", r"frombase64string"), ("IO_COMPRESSION", r"io\.compression"),
        ("DEFLATESTREAM", r"deflatestream"), ("MEMORYSTREAM", r"memorystream"),
    ]),
    "ScriptBlockText_StagerDetect": (3, [
        ("STAGER:REFLECTION_LOAD", r"\[system\.reflection\.assembly\]::load|\[reflection\.assembly\]::load"), ("STAGER:STAGED_IEX", r"iex\s*\(.*new-object\s+net\.webclient"),
        ("STAGER:STAGED_IEX", r"invoke-expression.*invoke-webrequest|iex.*iwr|iex.*invoke-restmethod"), ("STAGER:INMEMORY_NET", r"frombase64string.*\.load\(|\.load\(.*frombase64string"),
        ("STAGER:AMSI_THEN_EXEC", r"(?s)(?=.*amsi)(?=.*(iex|invoke-expression|\.invoke\())"), ("STAGER:APPDOMAIN", r"appdomain\.currentdomain|definedynamicassembly|definedynamicmodule"),
        ("STAGER:RUNSPACE", r"\[powershell\]::create\(\)|addscript.*begininvoke|runspacefactory"), ("STAGER:CLM_BYPASS", r"languagemode.*fulllanguage|fulllanguagemode"),
        ("STAGER:WIN32_API", r"add-type.*dllimport.*kernel32|add-type.*dllimport.*ntdll"),
    ]),
    "TargetObject_SuspiciousRegistry": (None, [
        ("RUN_KEY", r"\\run\\|\\runonce\\"), ("SERVICE_KEY", r"\\services\\"), ("IFEO", r"image file execution options"), ("APPINIT_DLLS", r"appinit_dlls"), ("WINLOGON", r"winlogon"),
        ("COM_HIJACK", r"\\clsid\\|\\inprocserver"), ("SCHED_TASK", r"schedule\\taskcache"), ("SECURITY_POLICY", r"\\policies\\|\\security\\"),
    ]),
}

# --- parent programs: label -> names without .exe ----------------------------------------------------------------
PARENTS = [
    ("ANOMALY:OFFICE_SPAWN", ["winword", "excel", "powerpnt", "outlook", "msaccess", "mspub", "visio", "onenote", "eqnedt32"]),
    ("ANOMALY:BROWSER_SPAWN", ["chrome", "firefox", "msedge", "iexplore", "opera", "brave"]),
    ("ANOMALY:PDF_SPAWN", ["acrord32", "acrobat", "foxitreader", "foxitphantom", "sumatrapdf"]),
    ("ANOMALY:SCRIPT_CHAIN", ["wscript", "cscript", "mshta"]),
    ("ANOMALY:WMI_SPAWN", ["wmiprvse"]),
    ("ANOMALY:TASK_SPAWN", ["taskeng", "taskhostw"]),
    ("ANOMALY:JAVA_SPAWN", ["java", "javaw", "javaws"]),
]

# --- sensitive files ---------------------------------------------------------------------------------------------
CREDENTIAL_FILES = ["sam", "system", "security", "ntds.dit", "shadow", "passwd", ".kdbx", ".keychain", "secrets.ldb", "secrets.tdb"]
SENSITIVE = [
    ("SENSITIVE:NTDS", r"ntds\.dit"),
    ("SENSITIVE:SSH_KEY", r"id_rsa|id_ed25519|id_ecdsa|id_dsa|known_hosts|authorized_keys|\.ssh/config"),
    ("SENSITIVE:CERT_PRIVATE", r"\.(pfx|p12|pem|key)$"),
    ("SENSITIVE:BROWSER_DATA", r"login data|cookies|web data|logins\.json|signons\.sqlite|key3\.db|key4\.db|cert9\.db"),
    ("SENSITIVE:CONFIG", r"web\.config|\.env|wp-config\.php|credentials\.xml|unattend\.xml|sysprep\.xml|\.git-credentials|appsettings\.json|connectionstrings\.config"),
    ("SENSITIVE:MEMORY_DUMP", r"lsass.*\.dmp|\.hdmp$|procdump"),
]
DOUBLE_EXTENSION = r"\.(\w{2,5})\.(exe|scr|bat|cmd|com|pif|vbs|vbe|js|jse|wsh|wsf|ps1|msi|dll|hta|cpl)$"

# --- mining ------------------------------------------------------------------------------------------------------
MINING_PROTOCOL = r"stratum\+tcp://|stratum\+ssl://|stratum2\+tcp://"
MINING_POOLS = ["nanopool", "f2pool", "ethermine", "nicehash", "unmineable", "moneroocean", "minexmr", "hashvault", "supportxmr", "minergate", "antpool", "poolin", "viabtc", "slushpool", "flexpool", "hiveon", "crazypool", "herominers"]
MINING_WALLETS = [("MONERO", r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b"), ("BITCOIN", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"), ("ETHEREUM", r"\b0x[0-9a-fA-F]{40}\b")]
MINING_TOOLS = ["xmrig", "nbminer", "t-rex", "phoenixminer", "gminer", "lolminer", "teamredminer", "nanominer", "cpuminer", "cgminer", "bfgminer", "ethminer", "minerd"]
MINING_ARGS = r"--algo\s|--donate-level|--cpu-priority|--coin\s|--threads\s.*--algo"

# --- obfuscation -------------------------------------------------------------------------------------------------
ENV_SUBSTRING = r"%[^%]+:~\d+,\d+%"
ENV_NAMES = ["comspec", "pathext", "temp", "tmp", "appdata", "programdata"]
XOR_KEYS = ["0x35", "0x55", "0xAA", "0xFF", "35", "55", "170", "255"]
OBFUSCATED_IP = [r"0x[0-9a-fA-F]{8}", r"\d{9,10}$", r"0[0-7]{1,3}\.0[0-7]{1,3}\.0[0-7]{1,3}\.0[0-7]{1,3}", r"0x[0-9a-fA-F]+\.[0-9]+\.[0-9]+\.[0-9]+"]

# --- programs ----------------------------------------------------------------------------------------------------
LOLBINS = [
    "certutil", "mshta", "regsvr32", "rundll32", "wmic", "cscript", "wscript", "powershell", "cmd", "msiexec", "installutil", "regasm", "regsvcs", "msconfig", "msbuild",
    "cmstp", "certreq", "dnscmd", "eudcedit", "expand", "extrac32", "findstr", "forfiles", "ftp", "gpscript", "hh", "ieexec", "infdefaultinstall", "makecab", "mavinject",
    "pcalua", "pcwrun", "presentationhost", "replace", "rpcping", "runscripthelper", "syncappvpublishingserver", "control", "bash", "bitsadmin",
]
SYSTEM32_ONLY = [
    "svchost.exe", "csrss.exe", "lsass.exe", "services.exe", "smss.exe", "wininit.exe", "winlogon.exe", "spoolsv.exe", "taskhost.exe", "taskhostw.exe", "runtimebroker.exe",
    "lsm.exe", "conhost.exe", "dwm.exe", "sihost.exe", "fontdrvhost.exe",
]
EXPECTED_DIRS = {**{n: ["/windows/system32/"] for n in SYSTEM32_ONLY}, "explorer.exe": ["/windows/"], "dllhost.exe": ["/windows/system32/", "/windows/syswow64/"]}
TYPOSQUAT_PROGRAMS = [
    "svchost", "services", "lsass", "csrss", "smss", "wininit", "winlogon", "explorer", "taskhost", "taskhostw", "dwm", "conhost", "dllhost", "spoolsv", "searchindexer",
    "wmiprvse", "powershell", "cmd", "rundll32", "regsvr32", "mshta", "wmic", "cscript", "wscript", "msiexec", "certutil", "bitsadmin", "chrome", "firefox", "msedge",
    "iexplore", "outlook", "teams", "onedrive", "dropbox",
]
KNOWN_PROGRAMS = [
    "wevtutil", "vssadmin", "netstat", "nbtstat", "pathping", "tracert", "ipconfig", "netsh", "schtasks", "tasklist", "taskkill", "systeminfo", "hostname", "whoami", "quser",
    "qwinsta", "query", "logoff", "shutdown", "gpupdate", "gpresult", "auditpol", "secedit", "icacls", "takeown", "cacls", "attrib", "cipher", "compact", "expand", "makecab",
    "extrac32", "fsutil", "diskpart", "diskperf", "chkdsk", "chkntfs", "defrag", "sfc", "dism", "bcdedit", "bootcfg", "msinfo32", "perfmon", "resmon", "eventvwr", "compmgmt",
    "devmgmt", "diskmgmt", "taskschd", "lusrmgr", "secpol", "gpedit", "regedit", "regedt32", "pwsh", "powershell_ise", "command", "RuntimeBroker", "smartscreen",
    "fontdrvhost", "sihost", "ctfmon", "lsm", "wuauclt", "trustedinstaller", "winword", "excel", "powerpnt", "onenote", "msaccess", "mspub", "visio", "lync", "opera", "brave",
    "chromium", "vivaldi", "update", "updater", "googleupdate", "defender", "msmpeng", "nissrv", "mpcmdrun", "malwarebytes", "mbam", "avast", "avgui", "norton",
    "nortonsecurity", "slack", "zoom", "skype", "discord", "spotify", "steam", "vlc", "notepad", "notepad++", "calc", "mspaint", "wordpad", "write", "charmap", "magnify",
    "narrator", "code", "devenv", "msbuild", "vscode", "git", "node", "python", "java", "javaw", "dotnet", "nuget", "ping", "nslookup", "dig", "curl", "wget", "ssh", "scp",
    "sftp", "ftp", "telnet", "putty", "plink", "pscp", "psftp",
]

# --- domains -----------------------------------------------------------------------------------------------------
SECOND_LEVELS = ["co", "com", "org", "net", "gov", "ac", "edu"]
SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click", "link", "info"]
BRANDS = [
    ("GOV_US", ["irs", "ssa", "medicare", "usps", "uscis", "state", "treasury", "whitehouse", "usa", "dmv", "fbi", "cia", "dhs", "doj", "epa"]),
    ("GOV_UK", ["hmrc", "nhs", "dvla", "gov"]),
    ("GOV_EU", ["europa"]),
    ("GOV_FR", ["gouv"]),
    ("GOV_DE", ["bund"]),
    ("BANK", ["chase", "wellsfargo", "bankofamerica", "citibank", "usbank", "capitalone", "americanexpress", "amex", "discover", "paypal", "venmo", "zelle", "schwab", "fidelity", "vanguard"]),
    ("CRYPTO", ["coinbase", "binance", "kraken"]),
    ("TECH", ["microsoft", "google", "apple", "amazon", "facebook", "meta", "netflix", "linkedin", "twitter", "instagram", "whatsapp", "telegram", "dropbox", "zoom", "slack", "github", "gitlab", "adobe", "salesforce", "oracle", "vmware"]),
    ("EMAIL", ["outlook", "hotmail", "gmail", "yahoo", "icloud", "protonmail"]),
    ("CLOUD", ["office365", "office", "onedrive", "sharepoint", "azure", "aws"]),
    ("SECURITY", ["norton", "mcafee", "kaspersky", "avast", "malwarebytes", "crowdstrike"]),
    ("SHIPPING", ["fedex", "ups", "dhl", "usps"]),
]

# --- numbers -----------------------------------------------------------------------------------------------------
PORTS = {
    80: "HTTP", 443: "HTTPS", 445: "SMB", 3389: "RDP", 22: "SSH", 21: "FTP", 20: "FTP_DATA", 23: "TELNET", 53: "DNS", 25: "SMTP", 587: "SMTP", 465: "SMTP", 135: "RPC_NETBIOS",
    139: "RPC_NETBIOS", 137: "NETBIOS_NS", 138: "NETBIOS_DGM", 1433: "MSSQL", 3306: "MYSQL", 5432: "POSTGRESQL", 1521: "ORACLE", 27017: "MONGODB", 6379: "REDIS", 5985: "WINRM",
    5986: "WINRM", 88: "KERBEROS", 389: "LDAP", 636: "LDAPS", 3268: "LDAP_GC", 3269: "LDAPS_GC", 464: "KERBEROS_PASSWD", 4444: "METASPLOIT_DEFAULT", 4445: "METASPLOIT_ALT",
    8080: "ALT_HTTP", 8443: "ALT_HTTP", 8000: "DEV_HTTP", 8888: "DEV_HTTP", 9090: "OPENFIRE", 110: "POP3", 995: "POP3S", 143: "IMAP", 993: "IMAPS", 161: "SNMP", 162: "SNMP_TRAP",
    69: "TFTP", 514: "SYSLOG", 515: "LPD", 548: "AFP", 873: "RSYNC", 1080: "SOCKS", 1194: "OPENVPN", 1723: "PPTP", 2049: "NFS", 2375: "DOCKER", 2376: "DOCKER",
    5000: "DOCKER_REGISTRY", 5900: "VNC", 6000: "X11", 8081: "PROXY", 9200: "ELASTICSEARCH", 9300: "ELASTICSEARCH_CLUSTER", 11211: "MEMCACHED", 50000: "SAP",
}
LOGON_TYPES = {
    "0": "SYSTEM", "2": "INTERACTIVE", "3": "NETWORK", "4": "BATCH", "5": "SERVICE", "7": "UNLOCK", "8": "NETWORK_CLEARTEXT", "9": "NEW_CREDENTIALS", "10": "REMOTE_INTERACTIVE",
    "11": "CACHED_INTERACTIVE", "12": "CACHED_REMOTE_INTERACTIVE", "13": "CACHED_UNLOCK",
}

# --- credentials on command lines --------------------------------------------------------------------------------
_USER = r'(?P<username>(?:"((?:\\.|[^"\\])*)")|(?:[^\s"]+))'
_PASS = r'(?P<password>(?:"((?:\\.|[^"\\])*)")|(?:[^\s"]+))'
CREDENTIALS = [
    rf"net.+user\s+{_USER}\s+{_PASS}",
    rf"net.+use\s+(?P<share>\\\\\S+)\s+/USER:{_USER}\s+{_PASS}",
    rf"schtasks.+/U\s+{_USER}.+/P\s+{_PASS}",
    rf"wmic.+/user:\s*{_USER}.+/password:\s*{_PASS}",
    rf"psexec.+-u\s+{_USER}.+-p\s+{_PASS}",
]
BASE64_RUN = r"(?:[A-Za-z0-9+/]{4}){5,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
