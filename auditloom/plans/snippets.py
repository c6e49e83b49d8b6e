"""Code lines the bridges place into the driver tables' rows; positives for the rules and clean lines."""

from __future__ import annotations

SNIPPETS = [
    r"""cur.execute(f"select * from t where id = {user}")""",
    r"""subprocess.run(cmd, shell=True)""",
    r"""digest = hashlib.md5(blob).hexdigest()""",
    r"""fh = open(base + name)""",
    r"""node.innerHTML = page""",
    r"""users.find({ "name": "bob" })""",
    r"""requests.get(root + path)""",
    r"""obj = pickle.loads(raw)""",
    r"""tree = etree.parse(src)""",
    r"""SESSION_COOKIE_SECURE = False""",
    r"""X-Frame-Options: 'NONE'""",
    r"""res = conn.ldap.search(base, f"(uid={uid})")""",
    r"""doc.xpath(f"//a[@id='{key}']")""",
    r"""logger.info("login with password %s", pw)""",
    r"""return redirect(next_url)""",
    r"""sprintf("%s", left + right, a + b)""",
    r"""r = client.call(url, verify=False)""",
    r"""vals = request.args.getlist('q')""",
    r"""CORS_ORIGIN_ALLOW_ALL = True""",
    r"""salt = bcrypt.gensalt(4)""",
    r"""pick = random.choice(items)""",
    r"""out = eval(expr)""",
    r"""q = "select a from b where c like '%x%'" """,
    r"""HSTS = False""",
    r"""resp.set_cookie('k', 'v', samesite=None)""",
    r"""pat = re.compile('(a.*+)')""",
    r"""traceback.print_exc()""",
    r"""GITHUB_TOKEN = "abcdefghij0123456789" """,
    r"""path = tempfile.mktemp()""",
    r"""Class k = Class.forName(n)""",
    r"""key = RSA.generate(1024)""",
    r"""h = hashlib.new('md4')""",
    r"""logger.warn(msg.replace('\n', ''))""",
    r"""c = Cipher.getInstance("RSA/ECB/PKCS1Padding")""",
    r"""html = Markup(text)""",
    r"""p = hashlib.sha256(pw.encode())""",
    r"""c = Cipher.getInstance("AES/CBC/NoPadding")""",
    r"""url = "mysql://root:hunter2@db/x" """,
    r"""port = params._GET['port']""",
    r"""c = Cipher.getInstance("RC2")""",
    r"""cfg = yaml.load(fh, Loader=yaml.Loader)""",
    r"""assert user.isAdmin""",
    r"""const s = `${name} is here`""",
    r"""render_template(page, request.args)""",
    r"""head = "a\r\nb" """,
    r"""<div v-html="body"></div>""",
    r"""session.id = request.cookies""",
    r"""jwt.decode(tok, key, verify=False)""",
    r"""User(**request.form)""",
    r"""localStorage.setItem('token', tok)""",
    r"""request.files['f'].save(dest)""",
    r"""delete node; delete head""",
    r"""short n = 70000;""",
    r"""if os.path.exists(p): open(p)""",
    r"""for i in range(999999):""",
    r"""view.setJavaScriptEnabled(true)""",
    r"""host = "192.168.4.20" """,
    r"""app.run(host, debug=True)""",
    r"""except Exception: pass""",
    r"""api_key = "0123456789abcdef" """,
    r"""# TODO tidy this up""",
    r"""} catch (Throwable t) {""",
    r"""def f(a, b, c, d, e, g, h):""",
    r"""tmp = rows""",
    r"""# def old(x):""",
    r"""import a, b, c, d""",
    r"""wait = days * 86400""",
    r"""if flag == True:""",
    r"""sys.exit(1)""",
    r"""import urllib2""",
    r"""last = xs[ -1 ]""",
    r"""assert found == None""",
    r"""ratio = total / 0""",
    r"""t = threading.Thread(target=work)""",
    r"""public int size = 4;""",
    r"""http.csrf.disable()""",
    r"""gw = "10.1.2.3" """,
    r"""x = x""",
    r"""return total""",
    r"""    yield from rows""",
    r"""class Store:""",
    r"""with lock:""",
    r"""def add(left, right):""",
    r"""    return left + right""",
    r"""print("ready")""",
    r"""for row in rows:""",
    r"""logger.info("started")""",
    r"""names = sorted(names)""",
    r"""if value is None:""",
    r"""",".join(parts)""",
    r"""count += 1""",
    r"""evaluate_model(data_set)""",
    r"""password = os.environ["DB_PASS"]""",
    r"""self.assertTrue(ok)""",
    r"""open_requests = 3""",
    r"""version = "2.10.0" """,
    "",
]
