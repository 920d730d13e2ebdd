"""Short texts in four languages, made by hand and not taken from the tables, though samples of the tables had been read before: REAL must be kept,
RESIDUE excluded. One text a line, ¶ a line break."""

REAL_EN = """
The bridge was closed for maintenance on Monday.
His body was not found.
Permission denied by the court.
Entry to the temple was forbidden.
Cookies must cool before serving.
Super Bowl XXX was played in January.
Bake the cookies until the edges are brown.
The script of the film was rewritten twice.
She left the play script on the kitchen table.
The error was found by a student from Leeds.
A rounding error of this size hardly matters.
The treaty could not be signed before winter.
The lighthouse is no longer in service.
Access to the valley is restricted in winter.
The museum is temporarily closed for repairs until May.
Fishing is forbidden on Sundays.
The session of parliament ended in uproar.
The runner was timed out at the second checkpoint.
The old mill was moved in 1904 and later deleted from the register.
We could not find the spring that the map promised.
The explorers tried again the following year.
Flight 404 landed safely in Oslo.
The house at 500 Main Street burned down.
In 1503 the duke ordered a new wall.
The 502 bus runs from the harbour to the hill.
Type the word twice and press the return key.
The template for the coin was cut in silver.
Insert the tab into the slot and fold along the line.
Add your own spices if the soup tastes flat.
The text of the treaty is lost.
A sample of the rock was sent to Vienna.
The placeholder king ruled for only three months.
The Java language was designed by James Gosling.
Java is an island of Indonesia, and its script is called Aksara.
The browser grazed on low leaves, like all deer of its kind.
He worked as a loading hand at the docks.
Please close the gate, the sign on the fence said, but nobody did.
Sorry Day is held each May.
The internal quarrels weakened the guild more than any enemy.
The gateway of the abbey dates from the twelfth century.
Server was her first job, at a diner near the station.
Her request was refused by the council in 1871.
The requested sum was paid in grain.
The number e is the limit of (1 + 1/n)^n.
Set notation uses braces, as in {a, b, c}.
The price rose from $5 to $12 within a year.
Visitors saw the message "404 not found" for two days after the move.
A banner asked users to enable JavaScript, which few of them understood.
Lorem ipsum is a garbled passage of Cicero that printers have used since the sixteenth century.
The placeholder {{name}} stands for the name of the customer in the letters of the shop.
"""
RESIDUE_EN = """
404 Not Found
404 - Page not found¶The page you requested does not exist.
Error 500: Internal Server Error
503 Service Unavailable¶No server is available to handle this request.
Sorry, we couldn't find that page.
Oops! Something went wrong. Please try again later.
Access Denied¶You don't have permission to access this resource on this server.
403 Forbidden
502 Bad Gateway¶nginx/1.18.0
The page you are looking for has been moved or deleted.
This site is down for maintenance. We'll be back soon.
Your session has expired. Please log in again.
Too many requests. Please slow down and try again in a few minutes.
The requested URL /shop/item was not found on this server.
This page isn't available. The link may be broken, or the page may have been removed.
Connection timed out while contacting the upstream server.
Fatal error: Uncaught Error: Call to undefined function get_header() in /var/www/index.php:3
Traceback (most recent call last):¶  File "app.py", line 10, in <module>¶ValueError: bad input
java.lang.NullPointerException¶  at com.shop.Main.run(Main.java:42)
Warning: mysql_connect(): Access denied for user 'root'@'localhost'
This file could not be loaded.
Please enable JavaScript to view this page.
JavaScript is disabled in your browser. Please enable it to continue.
You need to enable JavaScript to run this app.
This website requires cookies. Please enable cookies in your browser.
Your browser is not supported. Please update your browser.
Checking your browser before accessing the site. This process is automatic.
Please turn on JavaScript and reload the page.
We've detected that JavaScript is disabled in this browser.
Verify you are human by completing the action below.
Loading...
Enable JavaScript and cookies to continue
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.
Quisque velit nisi, pretium ut lacinia in, elementum id enim.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Donec sodales sagittis magna. Sed consequat, leo eget bibendum sodales, augue velit cursus nunc.
asdf asdf asdf asdf
test test test test
xxx xxx xxx xxx
blah blah blah blah blah
This is a placeholder text. This is a placeholder text.
Dear {{first_name}},¶thank you for your order {{order_id}}.
Hello ${user.name}, welcome to ${site.title}!
{% block title %}{% endblock %}¶{{ content }}
<%= product.name %> costs <%= product.price %>.
[Insert your company name here]
Welcome to %SITE_NAME%! Your code is %CODE%.
Your text goes here. Click to edit this text.
{{title}}¶{{subtitle}}¶{{body}}
[TITLE]¶[YOUR NAME]¶Add a short description here.
"""
REAL_DE = """
Die Brücke war am Montag wegen Bauarbeiten gesperrt.
Der Leichnam wurde nie gefunden.
Der Zugang zum Tempel war Fremden verboten.
Die Plätzchen müssen vor dem Servieren abkühlen.
Das Drehbuch wurde zweimal umgeschrieben.
Der Fehler fiel erst einem Schüler auf.
Ein Rundungsfehler dieser Größe spielt kaum eine Rolle.
Der Vertrag konnte vor dem Winter nicht unterzeichnet werden.
Der Leuchtturm ist nicht mehr in Betrieb.
Das Museum bleibt bis Mai wegen Umbaus geschlossen.
Angeln ist sonntags verboten.
Die Sitzung des Landtags endete im Streit.
Die alte Mühle wurde 1904 verschoben und später abgerissen.
Wir fanden die Quelle nicht, die auf der Karte stand.
Im folgenden Jahr versuchten sie es noch einmal.
Flug 404 landete sicher in Oslo.
Das Haus in der Hauptstraße 500 brannte ab.
Im Jahr 1503 ließ der Herzog eine neue Mauer bauen.
Die Linie 502 fährt vom Hafen zum Berg.
Java ist eine Insel Indonesiens.
Die Sprache Java entstand in den neunziger Jahren.
Der Text des Vertrags ist verloren.
Eine Probe des Gesteins ging nach Wien.
Der Wartungsplan der Bahn ist auf zwei Jahre angelegt.
Leider regnete es den ganzen Sommer.
Die Bitte wurde 1871 vom Rat abgelehnt.
Der Server brachte den Gästen den Wein.
Die Verbindung der beiden Täler führt über einen Pass.
Der Titel des Buches stammt vom Verleger.
Die Überschrift der Zeitung nahm die halbe Seite ein.
Das Tor der Abtei stammt aus dem zwölften Jahrhundert.
Die Zahl e ist der Grenzwert von (1 + 1/n)^n.
Mengen schreibt man mit Klammern, etwa {a, b, c}.
Der Preis stieg in einem Jahr von 5 auf 12 Mark.
Besucher sahen zwei Tage lang die Meldung „404 nicht gefunden“.
Der Blindtext „Lorem ipsum“ geht auf eine Stelle bei Cicero zurück.
Der Platzhalter {{name}} steht in den Briefen des Ladens für den Namen des Kunden.
Der Wald wurde im Krieg abgeholzt und danach neu bepflanzt.
Die Gemeinde hat rund 3000 Einwohner und liegt an der Elbe.
Im Winter ist die Straße über den Pass oft unpassierbar.
Der Dieb wurde trotz langer Suche nicht gefunden.
Der Hund bellte, bis der Nachbar das Fenster schloss.
Nach der Ernte feiert das Dorf ein Fest am Fluss.
Sie schrieb ihren ersten Roman in nur drei Wochen.
Das Gericht verweigerte ihm den Zutritt zum Archiv.
Die Dampfmaschine wurde um 1820 durch ein Wasserrad ersetzt.
Der Roman existiert nur in einer einzigen Handschrift.
Die Seiten des alten Buches waren vergilbt.
Seit 1990 gehört die Insel zum Nationalpark.
Wer den Gipfel erreichen will, muss früh aufbrechen.
"""
RESIDUE_DE = """
404 - Seite nicht gefunden
Fehler 404¶Die angeforderte Seite existiert nicht.
Die Seite wurde nicht gefunden.
Diese Seite ist leider nicht verfügbar.
Seite nicht gefunden¶Die gesuchte Seite wurde verschoben oder gelöscht.
Interner Serverfehler
Fehler 500: Interner Serverfehler
503 Dienst nicht verfügbar
Zugriff verweigert¶Sie haben keine Berechtigung, diese Seite aufzurufen.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Hoppla! Da ist etwas schiefgelaufen.
Wartungsarbeiten¶Wir sind bald wieder für Sie da.
Die Website wird derzeit gewartet. Bitte kommen Sie später wieder.
Zu viele Anfragen. Bitte versuchen Sie es in einigen Minuten noch einmal.
Der Server ist nicht erreichbar.
Die Verbindung zum Server ist fehlgeschlagen.
Der Artikel konnte nicht geladen werden.
Zeitüberschreitung bei der Anfrage
Leider konnten wir die gesuchte Seite nicht finden.
Die Datei wurde nicht gefunden.
Datenbankfehler: Verbindung fehlgeschlagen
Bitte aktivieren Sie JavaScript.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu sehen.
Für diese Anwendung wird JavaScript benötigt.
JavaScript ist in Ihrem Browser deaktiviert.
Diese Website benötigt Cookies. Bitte erlauben Sie Cookies.
Ihr Browser wird nicht unterstützt. Bitte aktualisieren Sie Ihren Browser.
Ihr Browser ist veraltet.
Ihr Browser wird überprüft. Bitte warten.
Wird geladen...
Seite wird geladen. Aktivieren Sie JavaScript, falls nichts geschieht.
Skripte sind erforderlich. Bitte schalten Sie JavaScript ein.
Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod.
Blindtext Blindtext Blindtext
Dies ist ein Blindtext.
Platzhaltertext für den Abschnitt
bla bla bla bla bla
Test Test Test Test Test
Mustertext Mustertext Mustertext
Sehr geehrte/r {{anrede}} {{nachname}},¶Ihre Bestellung {{nummer}} ist da.
Hallo ${vorname}, willkommen bei ${firma}!
{{titel}}¶{{text}}
Hier Text einfügen
Hier Überschrift eingeben¶Beschreibung folgt
%VORNAME% %NACHNAME%, Ihr Code lautet %CODE%.
[Ihr Name]¶[Titel hier]
Bitte Titel eingeben¶Bitte Text eingeben
<%= seite.titel %>¶<%= seite.text %>
Beschreibung eingeben
"""
REAL_FR = """
Le pont était fermé lundi pour cause de travaux.
Son corps n'a jamais été retrouvé.
L'accès au temple était interdit aux étrangers.
Les biscuits doivent refroidir avant d'être servis.
Le scénario du film fut réécrit deux fois.
L'erreur fut remarquée par un élève de Lyon.
Une erreur d'arrondi de cette taille importe peu.
Le traité ne put être signé avant l'hiver.
Le phare n'est plus en service.
Le musée reste fermé jusqu'en mai pour rénovation.
La pêche est interdite le dimanche.
La session du parlement finit dans le tumulte.
Le vieux moulin fut déplacé en 1904 puis démoli.
Nous n'avons pas trouvé la source indiquée sur la carte.
Ils essayèrent encore l'année suivante.
Le vol 404 a atterri sans encombre à Oslo.
La maison du 500 rue Haute a brûlé.
En 1503, le duc fit bâtir un nouveau mur.
La ligne 502 va du port à la colline.
Java est une île d'Indonésie.
Le langage Java date des années quatre-vingt-dix.
Le texte du traité est perdu.
Un échantillon de la roche fut envoyé à Vienne.
Malheureusement, il plut tout l'été.
La demande fut refusée par le conseil en 1871.
La connexion entre les deux vallées passe par un col.
Le titre du livre est dû à l'éditeur.
La porte de l'abbaye date du douzième siècle.
Le nombre e est la limite de (1 + 1/n)^n.
On écrit les ensembles avec des accolades, comme {a, b, c}.
Le prix passa de 5 à 12 francs en un an.
Les visiteurs virent pendant deux jours le message « 404 introuvable ».
Le faux texte « Lorem ipsum » vient d'un passage de Cicéron.
La marque {{nom}} désigne le nom du client dans les lettres de la boutique.
La forêt fut abattue pendant la guerre puis replantée.
La commune compte environ 3000 habitants et borde la Loire.
En hiver, la route du col est souvent impraticable.
Le voleur resta introuvable malgré de longues recherches.
Le chien aboya jusqu'à ce que le voisin ferme la fenêtre.
Après la moisson, le village fait une fête au bord de la rivière.
Elle écrivit son premier roman en trois semaines.
Le tribunal lui refusa l'accès aux archives.
La machine à vapeur fut remplacée vers 1820 par une roue à eau.
Le roman n'existe que dans un seul manuscrit.
Les pages du vieux livre étaient jaunies.
Depuis 1990, l'île fait partie du parc national.
Qui veut atteindre le sommet doit partir tôt.
Le service religieux a lieu chaque dimanche à dix heures.
Le roi dut attendre la réponse du pape pendant deux mois.
Le serveur apporta le vin et les verres.
"""
RESIDUE_FR = """
404 - Page introuvable
Erreur 404¶La page demandée n'existe pas.
La page que vous recherchez est introuvable.
Cette page n'est plus disponible.
Page non trouvée¶La page a été déplacée ou supprimée.
Erreur interne du serveur
Erreur 500 : erreur interne du serveur
503 Service indisponible
Accès refusé¶Vous n'avez pas l'autorisation d'accéder à cette page.
Votre session a expiré. Veuillez vous reconnecter.
Une erreur est survenue. Veuillez réessayer plus tard.
Oups ! Une erreur s'est produite.
Site en maintenance¶Nous serons bientôt de retour.
Le site est en cours de maintenance. Merci de revenir plus tard.
Trop de requêtes. Veuillez réessayer dans quelques minutes.
Le serveur est momentanément indisponible.
La connexion au serveur a échoué.
L'article n'a pas pu être chargé.
Délai d'attente dépassé
Désolé, nous n'avons pas trouvé cette page.
Fichier introuvable
Connexion à la base de données impossible
Veuillez activer JavaScript.
Veuillez activer JavaScript dans votre navigateur pour voir cette page.
Cette application nécessite JavaScript.
JavaScript est désactivé dans votre navigateur.
Ce site utilise des cookies obligatoires. Veuillez autoriser les cookies.
Votre navigateur n'est pas pris en charge.
Votre navigateur est obsolète. Veuillez le mettre à jour.
Vérification de votre navigateur en cours. Veuillez patienter.
Chargement en cours...
Chargement. Activez JavaScript si rien ne se passe.
Vous devez activer JavaScript pour utiliser ce site.
Lorem ipsum dolor sit amet, consectetur adipiscing elit. Praesent ac massa at ligula.
Faux texte faux texte faux texte
Texte fictif pour la maquette
blabla blabla blabla
test test test test test
Texte d'exemple texte d'exemple texte d'exemple
bla bla bla bla
Bonjour {{prenom}} {{nom}},¶votre commande {{numero}} est prête.
Bonjour ${prenom}, bienvenue chez ${societe} !
{{titre}}¶{{texte}}
Insérez votre texte ici
Saisissez un titre¶Ajoutez une description ici
%PRENOM% %NOM%, votre code est %CODE%.
[Votre nom]¶[Titre ici]
Veuillez saisir le titre¶Veuillez saisir le texte
<%= page.titre %>¶<%= page.texte %>
Texte à compléter
"""
REAL_JA = """
橋は月曜日に工事のため閉鎖されていた。
遺体は見つからなかった。
寺への立ち入りは禁じられていた。
クッキーは冷ましてから出す。
映画の脚本は二度書き直された。
誤りに気づいたのは一人の学生だった。
この程度の丸め誤差はほとんど問題にならない。
条約は冬までに調印できなかった。
灯台はもう使われていない。
博物館は五月まで改修のため休館している。
日曜日の釣りは禁止されている。
議会の会期は混乱のうちに終わった。
古い水車小屋は1904年に移され、のちに取り壊された。
地図にある泉を見つけることはできなかった。
翌年、一行はもう一度挑んだ。
404便は無事オスロに着いた。
大通り500番の家は焼け落ちた。
1503年、公爵は新しい城壁を築かせた。
502系統のバスは港から丘へ向かう。
ジャワ島はインドネシアの島である。
Javaという言語は1990年代に生まれた。
条約の本文は失われている。
岩の標本はウィーンへ送られた。
その夏は雨ばかりだった。
願いは1871年に評議会で退けられた。
二つの谷は峠で結ばれている。
本の題名は出版者がつけた。
修道院の門は十二世紀のものである。
数eは(1 + 1/n)^nの極限である。
集合は{a, b, c}のように波括弧で書く。
値段は一年で5円から12円に上がった。
訪れた人は二日間「404 見つかりません」という表示を見た。
「Lorem ipsum」はキケロの文章に由来する。
店の手紙では{{name}}という印が客の名前を意味する。
森は戦時中に伐られ、その後植え直された。
村の人口は約3000人で、川沿いにある。
冬には峠道がしばしば通れなくなる。
泥棒は長い捜索の末にも見つからなかった。
犬は隣人が窓を閉めるまで吠え続けた。
収穫のあと、村では川辺で祭りが開かれる。
彼女は最初の小説を三週間で書いた。
裁判所は彼の文書館への立ち入りを拒んだ。
蒸気機関は1820年ごろ水車に置き換えられた。
その小説は一つの写本にしか残っていない。
古い本の頁は黄ばんでいた。
1990年から島は国立公園に含まれる。
頂上を目指すなら早く出発しなければならない。
礼拝は毎週日曜の十時に行われる。
王は教皇の返事を二か月待った。
給仕はぶどう酒と杯を運んできた。
"""
RESIDUE_JA = """
404 ページが見つかりません
404エラー¶お探しのページは存在しません。
お探しのページは見つかりませんでした。
このページは現在ご利用いただけません。
ページが見つかりません¶移動または削除された可能性があります。
サーバー内部エラー
エラー500：サーバーで問題が発生しました
503 サービスは一時的に利用できません
アクセスが拒否されました¶このページを表示する権限がありません。
セッションの有効期限が切れました。もう一度ログインしてください。
エラーが発生しました。しばらくしてから再度お試しください。
申し訳ありません。問題が発生しました。
ただいまメンテナンス中です。
サイトはメンテナンス中です。しばらくお待ちください。
アクセスが集中しています。時間をおいて再度お試しください。
サーバーに接続できません。
サーバーへの接続に失敗しました。
記事を読み込めませんでした。
接続がタイムアウトしました
申し訳ございませんが、ページが見つかりませんでした。
ファイルが見つかりません
データベースに接続できません
JavaScriptを有効にしてください。
このページを表示するにはJavaScriptを有効にしてください。
このアプリにはJavaScriptが必要です。
お使いのブラウザではJavaScriptが無効になっています。
このサイトはCookieを使用します。Cookieを許可してください。
お使いのブラウザは対応していません。
ブラウザが古いため表示できません。更新してください。
ブラウザを確認しています。お待ちください。
読み込み中...
読み込み中です。JavaScriptを有効にしてください。
スクリプトを有効にして再読み込みしてください。
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
ダミーテキストダミーテキストダミーテキスト
これはダミー文章です。
テストテストテストテスト
サンプルテキストサンプルテキスト
ほげほげほげほげ
ああああああああああああああああ
{{姓}}{{名}}様¶ご注文{{番号}}を承りました。
${名前}さん、${会社}へようこそ。
{{タイトル}}¶{{本文}}
ここに本文を入力してください
タイトルを入力¶説明を入力
%名前%様、コードは%コード%です。
【お名前】¶【会社名】
ここに見出しを入力してください¶ここに文章を入力
<%= 題名 %>¶<%= 本文 %>
この文章は書き換えてください。
"""


def _lines(block: str) -> list[str]:
    return [line.replace("¶", "\n") for line in block.strip().splitlines()]


REAL = {lang: _lines(block) for lang, block in (("en", REAL_EN), ("de", REAL_DE), ("fr", REAL_FR), ("ja", REAL_JA))}
RESIDUE = {lang: _lines(block) for lang, block in (("en", RESIDUE_EN), ("de", RESIDUE_DE), ("fr", RESIDUE_FR), ("ja", RESIDUE_JA))}
