"""Rule registry for line scans.

A rule is a regular expression searched anywhere in a physical line that still carries its newline.
``needs`` lists lower-case substrings, at least one of which every matching line contains; they
are a cheap test that spares most lines the regular expression. An empty list means no such test.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    family: str
    severity: str
    needs: tuple[str, ...] = field(default=())

    @property
    def guard(self) -> str:
        """A character that every match contains, if the substrings show one."""
        return "(" if self.needs and all("(" in need for need in self.needs) else ""

    def condition(self, raw: str, lowered: str) -> str:
        """SQL test of this rule on the columns ``raw`` and ``lowered``."""
        hit = f"{raw} RLIKE {sql_literal(self.pattern)}"
        if not self.needs:
            return hit
        some = " OR ".join(f"contains({lowered}, {sql_literal(need)})" for need in self.needs)
        return f"({some}) AND {hit}"


def sql_literal(value: str) -> str:
    """A Spark SQL string literal. Rules are handed over as one SQL text: building hundreds of
    column objects one call at a time takes the driver seconds."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


# Rule name, pattern, and the substrings a match always contains.
_SAST = [
    ("[OWASP A03:2021-Injection] SQL Injection Risk",
     r"""(?i)(?:\.execute\(|db\.query\(|DriverManager\.getConnection\(|mysql_query\(|pg_query\().*f?["'].*\{\w+\}.*["']""",
     (".execute(", "db.query(", "drivermanager.getconnection(", "mysql_query(", "pg_query(")),
    ("[OWASP A03:2021-Injection] Command Injection Risk",
     r"""(?i)(?:subprocess\.(?:run|Popen|call)\(.*shell\s*=\s*True|os\.system\(|exec\.Command\(|shell_exec\(|exec\(|system\(|IO\.popen\()""",
     ("subprocess.run(", "subprocess.popen(", "subprocess.call(", "exec.command(", "exec(", "system(", "io.popen(")),
    ("[OWASP A02:2021-Cryptographic Failures] Insecure Cryptography (MD5/SHA1)",
     r"""(?i)(?:hashlib\.(?:md5|sha1)\(|md5\.New\(|sha1\.New\(|md5\(|sha1\(|DigestUtils\.(?:md5Hex|sha1Hex)\()""",
     ("md5(", "md5.new(", "sha1(", "sha1.new(", "md5hex(", "sha1hex(")),
    ("[OWASP A01:2021-Broken Access Control] Path Traversal Risk",
     r"""(?i)(?:open\(\s*(?:\w+\s*\+\s*\w+|\w+\.join\(|f["'].*\{\w+\})|file_get_contents\(|FileStream\(|FileInputStream\()""",
     ("open(", "file_get_contents(", "filestream(", "fileinputstream(")),
    ("[OWASP A03:2021-Injection] Cross-Site Scripting (XSS)",
     r"""(?i)(?:render_template_string\(|innerHTML\s*=|echo\s+.*\$_GET|echo\s+.*\$_POST|response\.write\()""",
     ("render_template_string(", "innerhtml", "$_get", "$_post", "response.write(")),
    ("[OWASP A03:2021-Injection] NoSQL Injection Risk",
     r"""(?i)(?:\$where\s*[:=]|find\(\s*\{\s*["']\w+["']\s*:\s*f?["'])""",
     ("$where", "find(")),
    ("[OWASP A10:2021-SSRF] Server-Side Request Forgery (SSRF)",
     r"""(?i)(?:requests\.(?:get|post|put|delete|patch|request)|urllib\.request\.urlopen|http\.Get|HttpURLConnection)\(\s*(?:\w+\s*\+\s*\w+|\w+\.join|f["'].*\{\w+\})""",
     ("requests.get(", "requests.post(", "requests.put(", "requests.delete(", "requests.patch(", "requests.request(",
      "urllib.request.urlopen(", "http.get(", "httpurlconnection(")),
    ("[OWASP A08:2021-Software and Data Integrity Failures] Insecure Deserialization Risk",
     r"""(?i)(?:pickle\.loads\(|yaml\.load\(\s*\w+\s*\)|marshal\.loads\(|ObjectInputStream\()""",
     ("pickle.loads(", "yaml.load(", "marshal.loads(", "objectinputstream(")),
    ("[OWASP A05:2021-Security Misconfiguration] XML External Entity (XXE) Injection",
     r"""(?i)(?:XMLParser\(|parseString\(|etree\.parse\(|etree\.fromstring\(|DocumentBuilderFactory)""",
     ("xmlparser(", "parsestring(", "etree.", "documentbuilderfactory")),
    ("[OWASP A07:2021-Identification and Authentication Failures] Insecure Session/Cookie Settings",
     r"""(?i)(?:SESSION_COOKIE_SECURE\s*=\s*False|SESSION_COOKIE_HTTPONLY\s*=\s*False|WTF_CSRF_ENABLED\s*=\s*False)""",
     ("session_cookie_secure", "session_cookie_httponly", "wtf_csrf_enabled")),
    ("[OWASP A05:2021-Security Misconfiguration] Cross-Frame Scripting (XFS) / Clickjacking",
     r"""(?i)(?:X-Frame-Options\s*[:=]\s*["']ALLOW-FROM["']|X-Frame-Options\s*[:=]\s*["']NONE["'])""",
     ("x-frame-options",)),
    ("[OWASP A01:2021-Broken Access Control] Insecure Direct Object References (IDOR)",
     r"""(?i)(?:def\s+\w+\(\s*.*(?:id|user_id|uuid|account_id)\s*\)\s*:.*\n\s*.*(?:select|find|query)\()""",
     ("select(", "find(", "query(")),
    ("[OWASP A03:2021-Injection] LDAP Injection",
     r"""(?i)(?:ldap\.search\(|ldap\.search_s\(|InitialDirContext\(\).*(?:search|lookup)).*f?["'].*\{\w+\}.*["']""",
     ("ldap.search(", "ldap.search_s(", "initialdircontext()")),
    ("[OWASP A03:2021-Injection] XPath Injection",
     r"""(?i)(?:\.xpath\(|\.evaluate\(|XPathFactory\.newInstance\(\)).*f?["'].*\{\w+\}.*["']""",
     (".xpath(", ".evaluate(", "xpathfactory.newinstance()")),
    ("[OWASP A09:2021-Security Logging and Monitoring Failures] Sensitive Data Exposure (Logging Leak)",
     r"""(?i)(?:logger\.(?:info|debug|warn|error)\(.*(?:api_key|password|secret|token|passwd|pwd).*\)|System\.out\.print.*(?:password|secret).*)""",
     ("logger.", "system.out.print")),
    ("[OWASP A01:2021-Broken Access Control] Open Redirect",
     r"""(?i)(?:redirect\(|response\.sendRedirect\(|window\.location\s*=\s*)(?:\w+\s*\+\s*\w+|\w+\.join|f["'].*\{\w+\}|\w+)""",
     ("redirect(", "window.location")),
    ("[OWASP A03:2021-Injection] Format String Vulnerability",
     r"""(?i)(?:printf\(|sprintf\(|format\().*(?:%s|%d).*,\s*(?:\w+\s*\+\s*\w+)""",
     ("printf(", "format(")),
    ("[OWASP A02:2021-Cryptographic Failures] Insecure Communication / SSL Verification Disabled",
     r"""(?i)(?:verify\s*=\s*False|verify\s*=\s*false|trustAllCerts|SSLContext\.getInstance\(\s*["']SSL["']\)|AllowAllHostnameVerifier)""",
     ("verify", "trustallcerts", "sslcontext.getinstance(", "allowallhostnameverifier")),
    ("[OWASP A03:2021-Injection] HTTP Parameter Pollution (HPP)",
     r"""(?i)(?:request\.args\.getlist|request\.query_params\.getlist|getParameterValues)""",
     ("request.args.getlist", "request.query_params.getlist", "getparametervalues")),
    ("[OWASP A01:2021-Broken Access Control] CORS Allow All Config",
     r"""(?i)(?:CORS_ORIGIN_ALLOW_ALL\s*=\s*True|Access-Control-Allow-Origin\s*[:=]\s*["']\*["'])""",
     ("cors_origin_allow_all", "access-control-allow-origin")),
    ("[OWASP A02:2021-Cryptographic Failures] Weak Cryptographic Salt / PBKDF2 Iterations",
     r"""(?i)(?:crypt\.pbkdf2|hashlib\.pbkdf2_hmac\(.*,\s*(?:[0-9]{1,3}|[0-9]{1,3}\s*\*\s*[0-9]{1,3})\s*,|bcrypt\.gensalt\(\s*(?:[1-7])\s*\))""",
     ("crypt.pbkdf2", "hashlib.pbkdf2_hmac(", "bcrypt.gensalt(")),
    ("[OWASP A02:2021-Cryptographic Failures] Weak Pseudo-Random Number Generator (PRNG)",
     r"""(?i)(?:random\.random\(|random\.randint\(|random\.choice\(|Math\.random\()""",
     ("random.random(", "random.randint(", "random.choice(", "math.random(")),
    ("[OWASP A03:2021-Injection] Code Injection Risk (eval/exec)",
     r"""(?i)(?:eval\(|exec\(|Function\(|evalString\()""",
     ("eval(", "exec(", "function(", "evalstring(")),
    ("[OWASP A03:2021-Injection] SQL Wildcard Injection",
     r"""(?i)(?:select\s+.*\s+like\s+.*%|like\s*.*_GET)""",
     ("like",)),
    ("[OWASP A01:2021-Broken Access Control] Missing Function Access Control",
     r"""(?i)(?:@app\.route\(.*method.*post.*\)\s*\n\s*def\s+\w+\(\)\s*:\s*\n\s*(?!@auth|@login_required|@roles_required|check_permission))""",
     ("@app.route(",)),
    ("[OWASP A05:2021-Security Misconfiguration] Insecure HSTS Settings",
     r"""(?i)(?:Strict-Transport-Security\s*.*max-age=0|HSTS\s*=\s*False)""",
     ("strict-transport-security", "hsts")),
    ("[OWASP A07:2021-Identification and Authentication Failures] Cookie without SameSite attribute",
     r"""(?i)(?:set_cookie\(.*samesite\s*=\s*None|SameSite\s*=\s*None)""",
     ("samesite",)),
    ("[OWASP A05:2021-Security Misconfiguration] Regex Denial of Service (ReDoS) Risk",
     r"""(?i)(?:re\.compile\(.*(?:\.\*|\.\+)\s*\+|re\.match\(.*(?:\.\*|\.\+)\s*\+)""",
     ("re.compile(", "re.match(")),
    ("[OWASP A09:2021-Security Logging and Monitoring Failures] Information Exposure through Exception Details",
     r"""(?i)(?:traceback\.print_exc\(|print_stack\(|printStackTrace\(\s*\)|e\.toString\(\))""",
     ("traceback.print_exc(", "print_stack(", "printstacktrace(", "e.tostring()")),
    ("[OWASP A02:2021-Cryptographic Failures] Hardcoded Sensitive Keys in Config",
     r"""(?i)(?:AWS_SECRET_ACCESS_KEY|STRIPE_API_KEY|GITHUB_TOKEN|SLACK_WEBHOOK_URL)\s*=\s*["'][a-zA-Z0-9_\-\.\~]{10,}["']""",
     ("aws_secret_access_key", "stripe_api_key", "github_token", "slack_webhook_url")),
    ("[OWASP A01:2021-Broken Access Control] Insecure Temporary File Creation",
     r"""(?i)(?:tempfile\.mktemp\(|mktemp\(|GetTempFileName\(\))""",
     ("mktemp(", "gettempfilename()")),
    ("[OWASP A03:2021-Injection] Unsafe Java Reflection usage",
     r"""(?i)(?:Class\.forName\(|getDeclaredMethod\(|Method\.invoke\()""",
     ("class.forname(", "getdeclaredmethod(", "method.invoke(")),
    ("[OWASP A02:2021-Cryptographic Failures] Weak Cryptographic Key Size",
     r"""(?i)(?:RSA\.generate\(1024\)|RSA\.generate\(512\)|keySize\s*=\s*1024|keySize\s*=\s*512)""",
     ("rsa.generate(", "keysize")),
    ("[OWASP A02:2021-Cryptographic Failures] Broken Cryptographic Hash / MD4 usage",
     r"""(?i)(?:hashlib\.new\(\s*["']md4["']\s*\)|DigestUtils\.md4Hex)""",
     ("hashlib.new(", "digestutils.md4hex")),
    ("[OWASP A09:2021-Security Logging and Monitoring Failures] Improper Output Neutralization (Log Injection)",
     r"""(?i)logger\..*\(.*replace\(['"]\\n['"],\s*['"]['"]\)""",
     ("logger.",)),
    ("[OWASP A02:2021-Cryptographic Failures] Insecure Cryptographic Padding",
     r"""(?i)(?:Cipher\.getInstance\(\s*["'].*/PKCS1Padding["']|algorithms\.AES\(.*,\s*modes\.ECB\(\s*\)\))""",
     ("cipher.getinstance(", "algorithms.aes(")),
    ("[OWASP A03:2021-Injection] Stored or Reflected XSS Input",
     r"""(?i)(?:Markup\(|_GET\[.*\]|_POST\[.*\]|dangerouslySetInnerHTML)""",
     ("markup(", "_get[", "_post[", "dangerouslysetinnerhtml")),
    ("[OWASP A02:2021-Cryptographic Failures] Use of Password Hash without Salt",
     r"""(?i)(?:hashlib\.sha256\(\w+\.encode\(\)\)|hashlib\.sha512\(\w+\.encode\(\)\))""",
     ("hashlib.sha256(", "hashlib.sha512(")),
    ("[OWASP A02:2021-Cryptographic Failures] Insecure Cryptographic Cipher Mode",
     r"""(?i)(?:/CBC/PKCS5Padding|/CBC/NoPadding)""",
     ("/cbc/pkcs5padding", "/cbc/nopadding")),
    ("[OWASP A02:2021-Cryptographic Failures] Hardcoded Credentials in Connection String",
     r"""(?i)(?:mongodb\+srv:\/\/|mysql:\/\/|postgresql:\/\/)[a-zA-Z0-9_\-]+:[a-zA-Z0-9_\-]+@""",
     ("mongodb+srv://", "mysql://", "postgresql://")),
    ("[OWASP A03:2021-Injection] Resource Injection (IP/Port manipulation)",
     r"""(?i)(?:socket\.connect\(\s*\(\s*_GET|_GET\[['"]port['"]\])""",
     ("_get",)),
    ("[OWASP A02:2021-Cryptographic Failures] Use of Broken Cryptographic Algorithm RC2",
     r"""(?i)(?:DigestUtils\.rc2Hex|Cipher\.getInstance\(\s*["']RC2["']\))""",
     ("digestutils.rc2hex", "cipher.getinstance(")),
    ("[OWASP A08:2021-Software and Data Integrity Failures] Vulnerable YAML Deserialization",
     r"""(?i)(?:yaml\.load\(\s*.*?\s*(?:,\s*Loader\s*=\s*yaml\.(?:Loader|UnsafeLoader|FullLoader))?\))""",
     ("yaml.load(",)),
    ("[OWASP A01:2021-Broken Access Control] Use of Assertions for Access Control Security",
     r"""(?i)(?:assert\s+.*hasRole|assert\s+.*isAdmin|assert\s+.*authorized)""",
     ("assert",)),
    ("[OWASP A03:2021-Injection] Expression Language (EL) Injection",
     r"""(?i)(?:\$\{\s*.*?\s*\}|#\{\s*.*?\s*\})""",
     ("${", "#{")),
    ("[OWASP A03:2021-Injection] Server-Side Template Injection (SSTI)",
     r"""(?i)(?:render_template\(.*request\..*|render_template_string\(.*request\..*)""",
     ("render_template(", "render_template_string(")),
    ("[OWASP A03:2021-Injection] CRLF Injection / HTTP Response Splitting",
     r"""(?i)(?:\\r\\n|\b\w+\.replace\(['"]\\n['"],['"]\\r['"]\))""",
     ("\\r\\n", ".replace(")),
    ("[OWASP A03:2021-Injection] Client-Side Template Injection",
     r"""(?i)(?:ng-bind-html|v-html|dangerouslySetInnerHTML)""",
     ("ng-bind-html", "v-html", "dangerouslysetinnerhtml")),
    ("[OWASP A07:2021-Identification and Authentication Failures] Session Fixation",
     r"""(?i)(?:session\.id\s*=\s*request|session\.session_id\s*=\s*)""",
     ("session.id", "session.session_id")),
    ("[OWASP A07:2021-Identification and Authentication Failures] Insecure JWT Validation",
     r"""(?i)(?:jwt\.decode\(.*verify\s*=\s*False|jwt\.decode\(.*options\s*=\s*\{.*verify_signature.*False)""",
     ("jwt.decode(",)),
    ("[OWASP A01:2021-Broken Access Control] Mass Assignment",
     r"""(?i)(?:\*\*request\.form|\*\*request\.get_json\(\)|\*\*request\.json)""",
     ("**request.",)),
    ("[OWASP A02:2021-Cryptographic Failures] Cleartext Storage of Sensitive Information",
     r"""(?i)(?:localStorage\.setItem\(.*(?:password|api_key|token)|cookies\.set\(.*(?:password|api_key|token))""",
     ("localstorage.setitem(", "cookies.set(")),
    ("[OWASP A03:2021-Injection] Unrestricted File Upload",
     r"""(?i)(?:request\.files.*save\(|MultipartFile|FileUpload)""",
     ("request.files", "multipartfile", "fileupload")),
    # The two starred alternations below are written as [\s\S]* so that Java matches long lines.
    ("[OWASP A08:2021-Software and Data Integrity Failures] Memory Corruption / Use-After-Free",
     r"""\b(?:free\s*\(.*\)[\s\S]*free\s*\(.*\)|free\s*\(.*\)[\s\S]*\b\w+\s*=|\bdelete\s+.*delete\s+.*)\b""",
     ("free", "delete")),
    ("[OWASP A03:2021-Injection] Integer Overflow/Wraparound",
     r"""(?i)(?:short\s+\w+\s*=\s*\d+|byte\s+\w+\s*=\s*\d+)""",
     ("short", "byte")),
    ("[OWASP A01:2021-Broken Access Control] Race Condition / TOCTOU",
     r"""(?i)(?:os\.path\.exists\(.*\)[\s\S]*open\(|file\.exists\(.*\)[\s\S]*file\.write)""",
     ("os.path.exists(", "file.exists(")),
    ("[OWASP A04:2021-Insecure Design] Uncontrolled Resource Consumption / DoS",
     r"""(?i)(?:while\s+True\s*:\s*\n\s*pass|for\s+\w+\s+in\s+range\(\s*(?:999999|1000000|sys\.maxsize)\s*\))""",
     ("while", "range(")),
    ("[OWASP A01:2021-Broken Access Control] Mobile Specific (Intent/WebView/Biometric)",
     r"""(?i)(?:setJavaScriptEnabled\(true\)|addJavascriptInterface|exported\s*=\s*true|biometricPrompt)""",
     ("setjavascriptenabled(", "addjavascriptinterface", "exported", "biometricprompt")),
    ("[OWASP A04:2021-Insecure Design] Hardcoded IP Addresses",
     r"""\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3})\b""",
     ("10.", "192.168.", "172.")),
    ("[OWASP A05:2021-Security Misconfiguration] Debug Code Left in Production",
     r"""(?i)(?:app\.run\(.*debug\s*=\s*True|DEBUG\s*=\s*True)""",
     ("debug",)),
]

# Code-smell rule name, pattern, and the substrings a match always contains.
_SMELLS = [
    ("Empty Exception Handler",
     r"""(?i)(?:except\s*:\s*\n\s*pass|except\s+Exception\s*:\s*\n?\s*pass|catch\s*\(\s*\w+\s*\)\s*\{\s*\}|catch\s*\(\s*Exception\s+\w+\s*\)\s*\{\s*\})""",
     ("except", "catch")),
    ("Hardcoded Credential / Secret",
     r"""(?i)(?:api_key|password|secret|token|passcode|private_key)\s*=\s*["'][a-zA-Z0-9_\-\.\~]{8,}["']""",
     ("api_key", "password", "secret", "token", "passcode", "private_key")),
    ("Leftover TODO/FIXME Comment", r"""(?i)(?:#|//|/\*)\s*(?:todo|fixme)""", ("todo", "fixme")),
    ("Broad Catch Block",
     r"""(?i)(?:except\s+Exception|catch\s*\(\s*Exception|catch\s*\(\s*Throwable)""",
     ("except", "catch")),
    ("Cognitive/Cyclomatic Complexity Smell",
     r"""(?i)(?:\s*if\s+.*:\s*\n\s*if\s+.*:\s*\n\s*if\s+.*:|\s*for\s+.*:\s*\n\s*for\s+.*:\s*\n\s*for\s+.*:)""",
     ("if", "for")),
    ("Long Parameter List",
     r"""(?i)def\s+\w+\(\s*\w+\s*,\s*\w+\s*,\s*\w+\s*,\s*\w+\s*,\s*\w+\s*,\s*\w+\s*,""",
     ("def",)),
    ("Naming Convention Violation",
     r"""\b(?:foo|bar|baz|temp|tmp|var|val|data)\d*\s*=\s*""",
     ("foo", "ba", "temp", "tmp", "va", "data")),
    ("Dead Code / Unused Local Variables", r"""(?i)#\s*def\s+\w+\(|#\s*class\s+\w+""", ("#",)),
    ("Duplicate Imports on One Line",
     r"""(?i)(?:import\s+\w+\s*,\s*\w+\s*,\s*\w+\s*,\s*\w+)""", ("import",)),
    ("Magic Number Usage",
     r"""(?i)(?:\* 86400|\* 3600|\* 1000|\* 60|\b3.1415926535\b)""",
     ("* 86400", "* 3600", "* 1000", "* 60", "1415926535")),
    ("Suboptimal Comparison / Redundant Boolean",
     r"""(?i)(?:==\s*True|==\s*False|!=\s*True|!=\s*False|==\s*true|==\s*false)""",
     ("==", "!=")),
    ("Empty Class or Method",
     r"""(?i)(?:def\s+\w+\(\s*.*?\)\s*:\s*\n\s*pass|class\s+\w+\s*:\s*\n\s*pass)""",
     ("pass",)),
    ("System Exit in Code",
     r"""(?i)(?:sys\.exit\(|os\._exit\(|System\.exit\()""",
     ("sys.exit(", "os._exit(", "system.exit(")),
    ("Use of Deprecated APIs",
     r"""(?i)(?:urllib2|optparse|md5\.new|sha\.new)""",
     ("urllib2", "optparse", "md5.new", "sha.new")),
    ("Cyclic Imports / Architectural Violation",
     r"""(?i)(?:import\s+.*?\s*;\s*\n\s*import\s+.*?\s*;\s*\n\s*import\s+.*?\s*;)""",
     ("import",)),
    ("Null Pointer Dereference Hazard",
     r"""(?i)(?:\b\w+\.delete\(\)\s*\n\s*\w+\.name|\b\w+\s*=\s*None\s*\n\s*\w+\.\w+)""",
     (".delete()", "none")),
    ("Array or Collection Out-of-Bounds Hazard",
     r"""(?i)(?:\[\s*-1\s*\]|\[\s*len\(\w+\)\s*\])""", ("-1", "len(")),
    ("Incorrect API Usage Pattern",
     r"""(?i)(?:assert\s+\w+\s*==\s*None|\.equals\(\s*\w+\s*\)\s*==\s*true)""",
     ("assert", ".equals(")),
    ("Mathematical Casting or Division-by-Zero Hazard",
     r"""(?i)(?:\/\s*0\b|%\s*0\b|\bint\(\s*float\(\s*\w+\s*\)\s*\))""", ("/", "%", "int(")),
    ("Thread-Safety Violation Hazard",
     r"""(?i)(?:threading\.Thread\(.*target\s*=\s*\w+.*\)\s*\n\s*(?!.*join|.*lock))""",
     ("threading.thread(",)),
    ("Encapsulation Violation (Public Field)",
     r"""(?i)(?:public\s+\w+\s+\w+\s*=\s*.*;)""", ("public",)),
    ("Disabled CSRF Configuration",
     r"""(?i)(?:csrf\.disable\(\)|WTF_CSRF_ENABLED\s*=\s*False|csrf_enabled\s*=\s*false)""",
     ("csrf",)),
    ("Hardcoded IP Address Config",
     r"""\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b""", ("10.", "192.168.")),
    ("God Class / Large Structural Smells",
     r"""(?i)class\s+\w+\s*\(.*?\)\s*:\s*\n(?:\s*def\s+\w+\(.*?\)\s*:\s*\n){10,}""",
     ("class",)),
    ("Redundant Assignment Duplication", r"""\b(\w+)\s*=\s*\1\b""", ("=",)),
]

SAST_RULES = [
    Rule(name, pattern, "sast", "HIGH", needs) for name, pattern, needs in _SAST
]
SMELL_RULES = [Rule(name, pattern, "smell", "INFO", needs) for name, pattern, needs in _SMELLS]


def owasp_class(rule_name: Column) -> Column:
    """``A03`` out of ``[OWASP A03:2021-...] ...``; NULL for rules without a class."""
    return F.nullif(F.regexp_extract(rule_name, r"^\[OWASP (A\d\d)", 1), F.lit(""))
