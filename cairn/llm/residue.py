"""Problem 10: texts that are template residue, filler, an error page or a demand for scripts.

A text is cut into segments (lines, sentences, menu entries, text between tags). Each segment is read by
delimiter-specific placeholder grammars and by patterns for filler, error and script notices. A pattern alone is weak
evidence: a whole sentence counts as a notice only if it also speaks as one, that is of the system's own things (page,
server, session), to the reader (imperative, second person) or with a notice's opening; a short segment only if
the notice is most of it. Sentences that report (quotation, a message or sign that someone saw, a dated past event),
code blocks and usage lines are discounted to prose. The decision is one of density: what remains as residue
must carry nearly all of the text, apart from a few neutral lines such as a title, menu or footer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import table

#: Share of the judged characters that residue must have.
DENSITY = 0.45
#: Lines without a verdict (a title, an unknown footer) that don't count against residue.
FREE_LINES = 4

_NAME = r"[^\W\d][\w .:|'’-]*?"
#: One grammar per delimiter pair: the name between them must look like a field name.
PLACEHOLDERS = {
    "braces": rf"\{{\{{\{{?\s*[#/^&>]?\s*{_NAME}\s*\}}?\}}\}}",
    "statement": r"\{%-?\s*[^%{}\n]+?-?%\}",
    "dollar": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash": rf"#\{{\s*{_NAME}\s*\}}",
    "single": r"(?<![A-Za-z0-9_${#%\\])\{\s*[^\W\d]\w*(?:[.:][\w.]+)?\s*\}(?![}A-Za-z0-9_])",
    "angle_percent": r"<%[=#-]?\s*[^%<>\n]+?\s*-?%>",
    "printf": r"%\(\s*[\w.: ]+\s*\)[sdif]",
    "percent": r"%[^\W\d][\w.]+%",
    "square": r"\[\[\[\s*[^\[\]\n]+\s*\]\]\]|\[(?:INSERT|ENTER|YOUR|ADD|TODO|PLACEHOLDER|TITLE|NAME|DATE)\b[^\[\]\n]*\]|\[[^\[\]\n]+ (?:here|hier|ici)\]|\[[^\[\]\n]+をここに\]|【[^【】\n]+】",
    "underscore": r"(?<![A-Za-z0-9_])__[^\W_](?:[\w.]*?[^\W_])?__(?![A-Za-z0-9_])",
    "crosses": r"(?<![A-Za-z])(?:xx_[\w.]+?_xx|XX_[\w.]+?_XX)(?![A-Za-z])",
    "at": r"(?<![A-Za-z0-9])@@?[^\W\d][\w.]*?@@?(?![A-Za-z0-9])",
    "dollars": r"(?<![A-Za-z0-9_$])\$[^\W\d][\w.]*?\$(?![A-Za-z0-9$])",
    "tildes": r"~~?[A-Z_]{3,}~~?|\|[A-Z_]{3,}\||\*\|[^|\n]+\|\*",
    "double_angle": r"<<\s*[^<>\n]+\s*>>|«\s*[^\W\d][\w.]*\s*»",
    "double_hash": r"##\s*[^\W\d]\w+\s*##",
    "angle": r"<\s*[^\W\d_][\w.-]*\s*>",
}
#: Elements that an angle placeholder must not be (fixed values).
_ELEMENTS = "html head body title h1 h2 h3 h4 p br hr div span a b i ul ol li table tr td th meta link script style noscript main nav header footer section article center strong em pre code img".split()

#: Instructions left in a template (fixed values).
INSTRUCTIONS = r"""
(?:add|insert|put|enter|write|type|paste)\ (?:your|the|a|an|some)?\ ?(?:short\ )?(?:text|summary|title|heading|description|introduction|caption|content|name)\b.{0,30}(?:here|characters|\.|\)|$)
|\b(?:text|heading|caption|title|summary|description|content|introduction|body|image|name)\ goes\ here\b|\breplace\ this\b|\bto\ be\ (?:supplied|written|completed|added)\b|^\W*(?:todo|tbd|fixme)\b
|\bwelcome\ to\ the\ article\ on\b|\bclick\ to\ edit\b|\bedit\ this\ text\b
|\bhier\ (?:\w+\ )?(?:text|titel|bild)\w*\ (?:einfügen|eingeben)|\b(?:überschrift|titel|text|zusammenfassung|kurzbeschreibung|bildunterschrift|beschreibung)\ (?:\w+\ )?(?:eingeben|einfügen|eintragen|folgt|ergänzen)\b|\bist\ zu\ ersetzen\b|\bfolgt\ hier\b|\bhier\ (?:steht|folgt)\b
|\binsére[rz]\ (?:le|un|votre)\b|\bsaisi(?:r|ssez)\ (?:le|un|une|votre)\b|\bsera\ placée?\ ici\b|\bà\ (?:remplacer|compléter|rédiger)\b|\b(?:texte|titre|légende|résumé)\ (?:\w+\ )?ici\b|\bremplacez\b
|ここに.{0,14}(?:書く|書いて|入力|記入|挿入|入れ)|(?:見出し|本文|題名|概要|要約|説明|タイトル)を?(?:入力|記入|追加)|書き換えてください|置き換えてください|が入ります|を入力してください
"""
#: Filler words and runs (fixed values).
FILLER = r"""
\blorem\b|\bipsum\b|\bthis\ is\ a\ test\b|\bdolor\ sit\b|\bconsectetur\b|\badipiscing\b
|\b(?:placeholder|sample|dummy|filler)\ (?:copy|text|content)\b|\btest\ test\b|\btext\ text\b|\bfoo\ bar\b|\basdf\w*|\bqwert?\w*\ ?\w*|\bblah?\ ?blah?\b
|\btexte\ (?:d['’]exemple|fictif|factice|bidon)|\bfaux\ texte\b|\bblabla\b|\bbla\ bla\b|\b(?:blind|muster|beispiel|platzhalter|füll)text\w*|\bplatzhalter\b
|ダミー(?:テキスト|文章?)?|(?:テスト){2,}|(?:サンプル|仮の)(?:テキスト|文章?|文字)|(?:文字){2,}|(?:ほげ){1,}|(?:ふが){1,}|あいうえお
"""
#: The same few letters or words over and over.
RUNS = r"([^\W_]{1,6}?)\1{7,}|(\b\w+(?:\ \w+){0,4}\ )\2{5,}"
#: A segment of nothing but x's.
CROSSES = r"^\W*(?:x{3,}\W*)+$"
#: The words of the usual filler generators (fixed values).
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea "
    "commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "quisque pretium lacinia vestibulum praesent donec maecenas mauris pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas integer nec odio cursus ante dapibus diam nibh elementum "
    "imperdiet sagittis fusce tellus augue semper porta massa eget consetetur sadipscing elitr nonumy eirmod invidunt arcu curabitur sodales ligula dignissim aliquam euismod nunc viverra vitae luctus venenatis suspendisse potenti phasellus hendrerit vel tincidunt "
    "ultrices posuere cubilia curae vivamus lectus risus orci nullam varius purus aenean leo accumsan libero faucibus cras justo ultricies etiam rhoncus blandit urna feugiat sapien at felis".split()
)
#: Little words that real Latin or a modern tongue in Latin letters hardly does without (fixed values).
_LITTLE = frozenset(
    "a an the of to in on at by for and or is are was were be it he she this that with from as not but his her its they we you i de la le les des du un une et est en dans que qui pour sur au aux ce ne pas il elle "
    "der die das ein eine und ist im von zu mit auf den dem nicht sich als auch es ich wir sie er el los las y por con no se su lo del al che di e i gli per-il non una sono si da ho ai na ya wa ni kwa "
    "cum quod quae ad ab sed sunt ut ex aut nec".split()
)
_LATIN_SHAPE = re.compile(r"[a-z]+(?:[aeiou]|u[ms]|is|[aeo]s|[aei]m|[aeiu]t|unt|ur|er)$")


#: Error pages and server messages (fixed values).
ERRORS = r"""
\b(?:http(?:/\d\.\d)?|error|status|code|erreur|fehler)[\ :\#-]{0,3}(?:code[\ :\#-]{0,3})?[3-5]\d\d\b|\b[45]\d\d\b\W{0,3}(?:-\s*)?(?:not\ found|forbidden|bad|internal|service|gateway|unauthori[sz]ed|error|gone|too\ many)
|\bnot\ found\b|\b(?:does|do|did)\ not\ exist\b|\bno\ such\ (?:page|file|article|entry|address)\b|\baccess\ (?:is\ )?(?:denied|forbidden|restricted)\b|\bforbidden\b|\b(?:do(?:es)?\ not|don['’]t)\ have\ permission\b|\bto\ handle\ (?:this|your|the)\ request\b|\bblocked\ by\b|\bpermission\ denied\b
|\b(?:service|temporarily|currently|is)\ (?:temporarily\ )?unavailable\b|\bbad\ (?:gateway|request)\b|\bgateway\ time-?out\b|\binternal\ (?:server\ )?error\b|\bsomething\ went\ wrong\b|\btry\ again\b|\btook\ too\ long\b|\btimed?[ -]?out\b|\btime\ exceeded\b
|\bsession\ (?:has\ |is\ )?expired\b|\b(?:sign|log)\ ?in\ (?:again|required|to\ (?:continue|read|view))|\blogin\ required\b|\brequested\ (?:resource|page|url|address)\b|\breference\ (?:number|id)\b|\bincident\ (?:number|id)\b|\bmay\ have\ been\ (?:moved|deleted|removed|renamed)\b
|\bcheck\ the\ (?:spelling|address|url)\b|\bgo\ back\ to\ the\ (?:start|home|main)\b|\bcontact\ the\ (?:operator|administrator|webmaster)\b|\btoo\ many\ requests\b|\bmade\ \d+\ requests\b|\b(?:rate|request)\ limit\b|\bcould\ not\ (?:read|connect|open|load|be\ (?:found|loaded|displayed|reached))\b|\bcan(?:'t|not)\ (?:reach|connect|be\ (?:displayed|reached|found))
|\b[\w.]*(?:exception|error):?(?:\s|$)(?=.*(?:\bat\ |:|$))(?<=exception)|\b\w+(?:\.\w+)+exception\b|^\s*at\ [\w$.<>]+\([\w.]*:?\d*\)|\bsqlstate\b|^\s*(?:warning|fatal\ error|notice|parse\ error|traceback)\b.{0,20}[:(]|\bmysql_\w+\(|\bstack\ ?trace\b|\bsegmentation\ fault\b|\bconnection\ (?:refused|reset|failed|closed)\b
|\b(?:under|scheduled|for)\ maintenance\b|\bwe(?:'ll|\ will)?\ (?:are|be)\ (?:back|sorry|down)|\bthis\ takes\ up\ to\ \d+|\bhas\ been\ (?:deleted|removed|suspended)\b|\bsubscription\ required\b|\bto\ read\ this\ article\b|\bapologi[sz]e\ for
|\b(?:is|are|was)\ (?:currently\ )?not\ available\b|\bis\ being\ (?:rebuilt|updated|moved)|\bcome\ back\ later\b|\b(?:could\ not|couldn't|couldn’t|cannot|can\ not|can't|can’t)\ (?:find|be)\b|\brefused\ the\ connection|\breturned\ an\ (?:empty|invalid)|\bhas\ been\ (?:moved|archived)|\bfailed\ with\ (?:code|error|status)|\bout\ of\ memory\b|\bfatal\ error\b|\brequest\ (?:id\b|[0-9a-f]{6,})|\bray\ [0-9a-f]{6,}|\bstack\ trace\ logged|^\W*(?:sorry|unfortunately|oops|whoops)\b|^\W*notice:|^\s*file\ ".{0,60}",\ line\ \d+|^\s*\w*(?:error|exception):\s|^\W*null\W*$
|\bnicht\ (?:gefunden|verfügbar|erreichbar|vorhanden)\b|\bexistiert\ nicht\b|\bzugriff\ (?:verweigert|gesperrt|verboten)|\bkeine\ (?:berechtigung|zugriffsrechte)|\bwartung(?:s(?:arbeiten|modus|fenster))?\b|\bwird\ (?:derzeit\ )?gewartet\b|\b(?:da\ )?ist\ etwas\ schief\w*(?:\ ge\w+)?|\bwir\ sind\ (?:bald|gleich)\ (?:wieder|zurück)\b|\bversuchen\ sie\ es\b|\bsitzung\b.{0,20}\babgelaufen|\bmelden\ sie\ sich\b.{0,12}\ban\b|\banmeldung\ erforderlich|\bserverfehler\b|\bzeitüberschreitung\b|\bverschoben\ oder\ gelöscht\b|\bgelöscht\ oder\ verschoben\b|\bprüfen\ sie\ die\b|\bfehler(?:code|nummer)?[\ :\#-]{0,3}\d{2,}|\betwas\ ist\ schief|\bzu\ viele\ anfragen\b|\bvorgang(?:snummer|skennung)?\ [0-9a-f]{6,}|\bvorgangs(?:nummer|kennung)\b|\bfehlgeschlagen\b|\b(?:bitte|später)\ .{0,20}\bversuchen\b|\berneut\ versuchen\b|\binterner\ (?:server)?fehler\b|\bgibt\ es\ (?:hier\ )?nicht|\b(?:kann|konnte|können)\b.{0,30}\bnicht\ (?:\w+\ )?(?:angezeigt|geladen|gefunden|erreicht|geöffnet)|\b(?:derzeit|zurzeit|momentan|gerade)\ nicht\b|^\W*leider\b|^\W*(?:hinweis|achtung|entschuldigung):|\bkommen\ sie\ später|\bnicht\ mehr\ (?:da|vorhanden)|\bwurde\ (?:gelöscht|entfernt|verschoben)|\bgesperrt\b
|\bintrouvable\b|\bn['’]existe\ (?:pas|plus)\b|\baccès\ (?:refusé|interdit|limité)|\bpas\ (?:l['’]autorisation|autorisée?)\b|\bindisponible\b|\ben\ maintenance\b|\bréessayer\b|\bréessayez\b|\berreur[\ :\#-]{0,3}(?:interne|du\ serveur|n[o°]\ ?)?[\ :\#-]{0,3}\d{2,}|\berreur\ (?:interne|du\ serveur)|\bsession\ (?:a\ )?expirée?|\b(?:vous\ )?reconnecter\b|\bconnexion\ (?:requise|refusée|impossible)|\bvérifie[zr]\ l['’](?:adresse|orthographe)|\bdéplacée?\ ou\ supprimée?|\bsupprimée?\ ou\ déplacée?|\btrop\ de\ requêtes\b|\béchec\ d[ue]\b|\bmomentanément\b|\bn['’](?:a|ont)\ pas\ pu\b|\bne\ (?:peut|peuvent)\ (?:pas\ )?être\b|\bdossier\ [0-9a-f]{6,}|^\W*(?:désolée?|malheureusement|avis\ ?:|oups)\b|\brevenez\ plus\ tard|\ba\ été\ (?:supprimée?|déplacée?)|\bdélai\ (?:d['’]attente\ )?dépassé|\bn['’]est\ plus\ (?:disponible|accessible)|\bserons\ (?:bientôt\ )?de\ retour\b|\ben\ cours\ de\ maintenance\b|\bmerci\ de\ revenir\b|\ba\ échoué\b|\bconnexion\b.{0,40}\bimpossible|\bune\ erreur\ (?:est|s['’]est)
|見つかりません|見つかりませんでした|に失敗しました|存在しません|(?:項目|頁|記事|画像|文書|ファイル)は?(?:あり|削除|移動)|はありません$|アクセス.{0,12}(?:拒否|禁止|できません|制限)|権限が(?:あり|必要)|エラー(?:コード|番号|が発生|\s*\d)|サーバー?.{0,10}(?:応答|エラー|障害)|メンテナンス|しばらく(?:して|たって|お待ち)|再度お試し|お試しください|期限が切れ|もう一度ログイン|ログインが?必要|再ログイン|ご確認ください|削除され(?:まし)?た|移動または|利用(?:でき|いただけ)ません|表示できません|読み込めません|(?:問題|障害|不具合)が発生|接続できません|予定時間|最大\d+秒|混み合って|混雑|タイムアウト|受付番号|問い合わせ番号|お知らせ[:：]|アクセスが集中|禁止されて|ブロックされ
"""
#: Demands for scripts, cookies or another browser (fixed values).
SCRIPTS = r"""
(?:enable|turn\ on|activate|allow|requires?|needs?|disabled|turned\ off|switched\ off|without|switch\ on|missing|blocked|off).{0,40}\b(?:java\ ?scripts?|scripts?|(?:client-side\ )?scripting|cookies?|js)\b|\b(?:java\ ?scripts?|scripts?|scripting|cookies?|js)\b.{0,40}(?:enabled?|disabled|turned\ (?:on|off)|switched\ (?:on|off)|required?|needed|necessary|allowed|accepted|blocked|missing|activated|unavailable|not\ (?:available|supported|running))
|\bbrowser\b.{0,40}\b(?:not\ supported|does\ not\ (?:run|support)|unsupported|too\ old|out\ of\ date|outdated|run\ scripts)\b|\bchecking\ your\ browser\b|\breload\ (?:the|this)\ page\b|^\W*loading\W*$|\bin\ the\ settings\ of\ your\ browser\b|\bupdate\ your\ browser\b|\bother\ browser\b|\bverify(?:ing)?\ (?:that\ )?you\ are\ (?:a\ )?human|\bare\ you\ a\ robot
|\b(?:java\ ?script|(?:client-side\ )?scripting|js|skripte?|cookies?)\b.{0,40}(?:benötigt|aktivier|erforderlich|abgeschaltet|ausgeschaltet|deaktiviert|erlaub|zulassen|nötig|einschalten)|(?:aktivier|benötig|erlaub|schalten|einschalten).{0,40}\b(?:java\ ?script|scripting|js|skripte?|cookies?)\b|\bbrowser\b.{0,30}(?:keine\ skripte|nicht\ unterstützt|veraltet|geprüft|überprüf)|\blade[nt]?\b.{0,20}\bneu\b|^\W*wird\ geladen\W*$|\bseite\ neu\ laden|in\ den\ einstellungen\b
|(?:activer|activez|nécessite|requiert|autoriser|autorisez|désactivé|sans|besoin|exige).{0,40}\b(?:java\ ?script|(?:client-side\ )?script(?:s|ing)?|cookies?|js)\b|\b(?:java\ ?script|scripts?|cookies?)\b.{0,40}(?:activé|désactivé|acceptés?|nécessaires?|requis|autorisés?|obligatoire|bloqué)|\bnavigateur\b.{0,40}(?:pris\ en\ charge|obsolète|scripts|vérifi|pas)|vérification\ de\ votre\ navigateur|\brecharge[zr]\b|\bactualise[zr]\b|^\W*chargement(?:\ en\ cours)?\W*$|réglages\ de\ votre\ navigateur|paramètres\ (?:de|du)\ (?:votre\ )?navigateur
|(?:java\ ?script|scripting|(?<![A-Za-z])js(?![A-Za-z])|スクリプト|cookie|クッキー).{0,24}(?:有効|必要|無効|許可|オン|オフ|動作|実行)|ブラウザ.{0,24}(?:対応|確認|設定|古い|サポート|動作)|(?:お使いの|この)ブラウザ|再読み込み|^\W*読み込み中\W*$|更新してください
"""
#: Menu and footer lines (fixed values).
NEUTRAL = r"""
^\W*(?:skip\ to\ content|back\ to\ top|zum\ inhalt|nach\ oben|aller\ au\ contenu|retour\ (?:à\ l['’]accueil|en\ haut)|haut\ de\ page|(?:zurück\ )?zur\ startseite|本文へ(?:スキップ)?|(?:ホーム|トップ|先頭|上)(?:ページ)?[へに](?:戻る)?|ページの?先頭へ)\W*$
|^\W*(?:home|accueil|start(?:seite)?|ホーム|トップ)\W*$|^\W*(?:index|help|hilfe|aide|索引|ヘルプ|inhalt|contact|kontakt|impressum)\W*$|^\s*copyright\b|\ball\ rights\ reserved\b
"""
#: Things of the system that a notice speaks of (fixed values).
SYSTEM = r"""
^\W*(?:die\ )?suche\b|\b[45]\d\d\ (?:not|forbidden|bad|internal|service|gateway|error|gone|too|unauthori[sz]ed)\b|^\W*(?:fatal\ )?(?:error|warning|notice|sqlstate)\b.{0,8}:
|\b(?:web)?(?:pages?|(?:web)?sites?|servers?|services?|files?|documents?|articles?|images?|resources?|requests?|requested|address(?:es)?|urls?|links?|sessions?|connections?|databases?|tables?|index(?:es)?|caches?|gateways?|networks?|browsers?|accounts?|login|password|system|operation|process|modules?|records?|clients?|search|catalog(?:ue)?|archive|directory|registry|quer(?:y|ies)|repl(?:y|ies)|responses?|errors?|exceptions?|code|host|domain|proxy|timeout|cookies?|scripts?|javascript|subscription|notice)\b
|\b(?:web)?(?:seiten?|server\w*|dienste?s?|dateie?n?|dokumente?|artikel|eintrag|einträge|bild(?:er)?|anfragen?|adressen?|links?|sitzung\w*|verbindung\w*|datenbank|tabelle|index|zwischenspeicher|cache|netzwerk|browser\w*|konto|anmeldung|passwort|system|register|verzeichnis|katalog|archiv|vorgang\w*|modul|antwort|fehler\w*|inhalte?|abruf|skripte?|zugriff\w*|wartung\w*|hinweis)\b
|\b(?:pages?|sites?|serveurs?|services?|fichiers?|documents?|articles?|fiche|entrée|images?|ressources?|requêtes?|adresses?|url|liens?|sessions?|connexion|bases?\ de\ données|tables?|index|caches?|réseau|navigateurs?|comptes?|mot\ de\ passe|système|opération|recherche|base|registre|catalogue|archives?|modules?|réponses?|erreurs?|accès|scripts?|cookies|avis|dossier\ [0-9a-f]{4,})\b
|ページ|頁|サイト|サーバ|サービス|ファイル|文書|記事|項目|画像|リンク|アドレス|URL|セッション|接続|データベース|表示|索引|キャッシュ|ネットワーク|ブラウザ|アカウント|ログイン|パスワード|システム|処理|エラー|アクセス|リクエスト|権限|メンテナンス|通信|操作|応答|お知らせ|番号
"""
#: Speech to the reader: imperatives and second person (fixed values).
TO_READER = r"""
\b(?:you|your|please|try|check|go\ back|contact|reload|refresh|return\ to|sign\ in|log\ in|click|enable|allow|turn\ on|activate|update|come\ back|wait|we(?:'re|\ are|'ll|\ will|\ apologi[sz]e))\b
|\b(?:bitte|ihre?[nmrs]?|sie|versuchen|prüfen|kehren|melden|laden|aktivieren|kommen\ sie|du|dein\w*)\b
|\b(?:vous|votre|vos|veuillez|merci\ de|réessaye[rz]|vérifie[rz]|revenez|retournez|contactez|activez|rechargez|actualisez|nous)\b
|ください|下さい|お試し|ご確認|お待ち|お探し|ご指定|ご覧|お使い|ません|ました|ます|です
"""
#: Frames of a report: someone met, read or showed a message, sign, placeholder or template (fixed values).
REPORT = r"""
\b(?:messages?|notices?|signs?|banners?|warnings?|words?|phrases?|placeholders?|templates?|manuals?|screens?|buttons?|labels?|marks?|fields?|readers?|visitors?|users?|printers?|people)\b.{0,30}\b(?:ask(?:s|ed)?|say(?:s|ing)?|said|reads?|show(?:s|ed|n)?|appear(?:s|ed)?|met|saw|see|got|received|stand(?:s|ing)?|stood|mean(?:s|t)|replac(?:es|ed)|fill(?:s|ed)|uses?|used|called|named|prints?|printed|wrote|writes?|contains?|greet(?:s|ed))\b
|\b(?<!not\ )(?:met|saw|read|showed|printed|wrote|displayed|got|received|called|means|stands\ for|explains|describes)\b.{0,30}\b(?:messages?|notices?|errors?|placeholders?|templates?|words?|phrases?)\b|\bstands?\ for\b|\berror\ rates?\b
|\b(?:meldung|hinweis|schild|vorlage|platzhalter|wort|wörter|besucher|leser|nutzer|handbuch|anzeige|drucker)\b.{0,40}\b(?:steht|stand|bat|baten|zeigt\w*|lautet\w*|sah(?:en)?|las(?:en)?|füllt\w*|erscheint|erschien|heißt|hieß|bedeutet|schrieb\w*|fanden?|begegnet\w*|trafen?)\b|\b(?:steht|stehen|stand)\ für\b|\b(?:sah(?:en)?|las(?:en)?|zeigte|fanden?|trafen?|erklärt|beschreibt)\b.{0,40}\b(?:meldung|hinweis|vorlage|platzhalter)\b
|\b(?:messages?|avis|panneaux?|modèles?|mot|mots|balise|lecteurs?|visiteurs?|manuel|écran|imprimante|marque)\b.{0,40}\b(?:demand(?:e|ait|a)|dit|disait|indiqu(?:e|ait|a)|affich(?:e|ait|a)|appara[iî](?:t|ssait)|rest(?:e|ait|a)|signifi(?:e|ait)|rempli(?:t|ssait)|virent|lurent|rencontr\w+|remplac\w+|marque|désigne|contient)\b|\bmarque(?:nt)?\ (?:la\ place|l['’]endroit)\b
|雛形で|という(?:文字|表示|言葉|警告|通知|メッセージ|案内|注意)|と(?:書|記|表示|出|読)[いかさまれて]|表示が(?:出|続|残|現)|を求める(?:表示|案内|掲示)|を意味(?:し|する)|として使われ
"""
#: A date or a span of days.
DATED = r"\b(?:1[0-9]|20)\d\d\b(?!\s*(?:s|sec|ms|min)\b)|\b\d+\ (?:days|weeks|months|years|tage|wochen|monate|jahre|jours|semaines|mois|ans)\b|\d年|\d+(?:日|週|か月|年)間|\b(?:on|by|last|next)\ (?:mon|tues|wednes|thurs|fri|satur|sun)day"
#: A completed event, told: past forms (fixed values).
PAST = r"""
\b(?:was|were|had|became|lay|stood|met|kept|asked|called|until|since|ago|during)\b|\bin\ (?:1\d|20)\d\d\b|\bfor\ \d+\ (?:days|weeks|months|years)\b
|\b(?:war(?:en)?|wurden?|hatten?|blieb(?:en)?|galt(?:en)?|kam(?:en)?|stand(?:en)?|lag(?:en)?|bis|seit|vor|während)\b|\b(?:1\d|20)\d\d\b|\b\d+\ (?:tage|wochen|monate|jahre)\b
|\b(?:étai(?:t|ent)|fut|furent|avai(?:t|ent)|rest(?:a|èrent)|devint|jusqu['’]|depuis|pendant|durant)\b|\b\d+\ (?:jours|semaines|mois|ans)\b
|\d年|\d+(?:日|週|か月|年)間|当時|だった|であった|ていた|(?<!し)た。|していた
"""
QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|\"[^\"\n]*\"")


def _compile(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE | re.VERBOSE)


_PLACEHOLDERS = {k: re.compile(v) for k, v in PLACEHOLDERS.items()}
_INSTRUCTIONS, _FILLER, _ERRORS, _SCRIPTS, _NEUTRAL, _RUNS, _CROSSES = map(_compile, (INSTRUCTIONS, FILLER, ERRORS, SCRIPTS, NEUTRAL, RUNS, CROSSES))
_SYSTEM, _TO_READER, _REPORT, _PAST, _DATED = map(_compile, (SYSTEM, TO_READER, REPORT, PAST, DATED))
_TAG = re.compile(r"</?(?:" + "|".join(_ELEMENTS) + r")\b[^<>\n]*>|<!--.*?(?:-->|\Z)|<!doctype[^<>]*>", re.IGNORECASE | re.DOTALL)
_USAGE = re.compile(r"^\s*(?:usage:|options:|synopsis|-{1,2}\w[\w-]*[ ,=<\[{$]|\$ \w)|^\s*exit status|\[-\w|^(?: {2,}|\t)(?:-|\w+\s*[({=]|<\w+>\s{2,})", re.IGNORECASE)
_TRACE = re.compile(r"^\s*(?:File \".{0,80}\", line \d+|at [\w$.<>]+\([\w.]*:?\d*\)|Traceback \(most recent call)", re.IGNORECASE)
_SPLIT = re.compile(r"\r\n|[\n\r  \x0b\x0c\x85]|(?<=[.!?…])\s+(?=[^\s])|(?<=[。！？])|\s[-–—|·•]\s|[|｜]|(?:©|\(c\)) ?[\w.-]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters whose case the patterns fold otherwise than ``lower`` does; a segment with one of them meets every pattern.
_FOLDS = re.compile("[\u017f\u212a\u0130\u0131]")
#: Characters of which every placeholder has one.
_DELIMITER = re.compile(r"[{$%\[【_@~|<«#]")
_NAMED = re.compile(r"\b(?:lorem|ipsum)\b", re.IGNORECASE)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_END = re.compile(r"[.!?。！？…][\"”“»」)）]*\s*$")


def required_literals(pattern: str) -> set[str] | None:
    """Lower-case strings of which every match of ``pattern`` (verbose, ignoring case) holds at least one; None if unknown.

    Read off the parsed pattern: of a sequence the item whose shortest string is longest, of alternatives all of them.
    """
    from re import _parser as parser

    def of(items) -> set[str] | None:
        best: set[str] | None = None
        run = ""

        def offer(found: set[str] | None) -> None:
            nonlocal best
            if found and (best is None or min(map(len, found)) > min(map(len, best))):
                best = found

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg).lower()
                continue
            offer({run} if run else None)
            run = ""
            if name == "SUBPATTERN":
                offer(of(arg[3]))
            elif name == "BRANCH":
                each = [of(branch) for branch in arg[1]]
                offer(None if any(x is None for x in each) else set().union(*each))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                offer(of(arg[2]))
        offer({run} if run else None)
        return best

    return of(parser.parse(pattern, re.IGNORECASE | re.VERBOSE))


@lru_cache(maxsize=1)
def _triggers():
    """One automaton over the literals that the four residue patterns require, or None where it can't be built.

    A segment without any of a pattern's literals cannot match it, so the pattern needn't run; where there is no
    automaton every pattern runs, with the same verdicts.
    """
    try:
        import ahocorasick

        masks: dict[str, int] = {}
        for bit, pattern in enumerate((INSTRUCTIONS, SCRIPTS, ERRORS, FILLER)):
            literals = required_literals(pattern)
            if not literals:
                return None
            for x in literals:
                masks[x] = masks.get(x, 0) | 1 << bit
        automaton = ahocorasick.Automaton()
        for x, mask in masks.items():
            automaton.add_word(x, mask)
        automaton.make_automaton()
        return automaton
    except (ImportError, AttributeError):
        return None


def outside_code(text: str) -> str:
    """The text without its fenced code blocks; a fence that is never closed opens none. One pass over the lines."""
    if "```" not in text and "~~~" not in text:
        return text
    kept: list[str] = []
    block: list[str] = []
    fence = ""
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if not fence and bare[:3] in ("```", "~~~"):
            fence, block = bare[:3], [line]
        elif fence:
            block.append(line)
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence, block = "", []
        else:
            kept.append(line)
    return "".join(kept + block)


def placeholders(segment: str) -> list[str]:
    """The delimiter kinds of the placeholders in ``segment``, one entry per placeholder."""
    found: list[str] = []
    if not _DELIMITER.search(segment):
        return found
    for kind, pattern in _PLACEHOLDERS.items():
        if kind == "single" and found and "{{" in segment:
            continue
        for m in pattern.finditer(segment):
            if kind == "angle" and m[0][1:-1].lower() in _ELEMENTS:
                continue
            found.append(kind)
    return found


def _latin(words: list[str], known: bool) -> bool:
    """Whether a segment's words are filler Latin: mostly generator words, or Latin in shape without any little word.

    ``known`` says that the text names itself (lorem, ipsum); otherwise shape alone needs six words in lower case,
    hardly one of them short.
    """
    if len(words) < 4:
        return False
    low = [w.lower() for w in words]
    if sum(w in LOREM for w in low) >= 0.7 * len(low) and sum(w in _LITTLE for w in low) <= 0.3 * len(low):
        return True
    if any(w in _LITTLE for w in low) or sum(bool(_LATIN_SHAPE.match(w)) for w in low) < 0.85 * len(low):
        return False
    return known or len(words) >= 6 and all(w.islower() for w in words[1:]) and sum(len(w) <= 3 for w in words) <= 0.35 * len(words)


def _may_run(s: str) -> bool:
    """Whether half of a segment can be one run: then a token is half of it, or words recur at least three times."""
    tokens = s.lower().split()
    return 2 * max(map(len, tokens)) >= len(s) or len(tokens) - len(set(tokens)) >= 3


def _reports(s: str, words: list[str]) -> bool:
    """Whether a sentence tells of such things rather than being one."""
    whole = bool(_END.search(s)) or len(words) > 7
    if not whole:
        return False
    return bool(_REPORT.search(s)) or bool(_PAST.search(s)) and not _TO_READER.search(s) and (bool(_DATED.search(s)) or not _SYSTEM.search(s))


def _speaks(kind: str, s: str, words: list[str], found: list[str]) -> bool:
    """Whether a segment with the matches ``found`` of a pattern speaks as an error or script notice."""
    letters = sum(c.isalnum() for c in s)
    if len(found) > 1 or sum(c.isalnum() for m in found for c in m) >= 0.65 * letters:
        return True
    if _CJK.search(s):
        return len(s) < 12 or bool(_TO_READER.search(s)) or not _END.search(s) and bool(_SYSTEM.search(s))
    if kind == "error" and not _SYSTEM.search(s) and not _TO_READER.search(s):
        return len(words) <= 6 and not _END.search(s)
    return True


def judge(segment: str, known: bool = False) -> str:
    """One of template, filler, error, script, weak, prose, neutral, menu, symbols (a run without letters), empty.

    A weak segment has a notice's words but doesn't speak as one: it is a notice beside others, prose without them.

    ``known``: the whole text holds words that name filler Latin.
    """
    s = segment.strip()
    if not s or not any(c.isalnum() for c in s):
        return "symbols" if len(s) >= 24 and len(set(s)) <= 4 else "empty"
    if _USAGE.search(segment) or segment.count("\t") > 1:
        return "prose"
    if _TRACE.search(s):
        return "error"
    if _NEUTRAL.search(s):
        return "menu"
    words = _WORD.findall(s)
    held = placeholders(s)
    if held:
        # naming words beside few placeholders: a sentence about a template; a sentence built on them: residue
        inside = sum(len(m[0]) for p in _PLACEHOLDERS.values() for m in p.finditer(s))
        if len(held) <= 2 and inside < 0.35 * len(s) and (_END.search(s) or len(words) > 7) and _REPORT.search(s):
            return "prose"
        return "template"
    if _latin(words, known) or _CROSSES.search(s):
        return "filler"
    automaton, mask = _triggers(), 15
    if automaton is not None and not _FOLDS.search(s):
        mask = 0
        for _, bits in automaton.iter(s.lower()):
            mask |= bits
    for bit, (kind, pattern) in enumerate((("template", _INSTRUCTIONS), ("script", _SCRIPTS), ("error", _ERRORS), ("filler", _FILLER), ("filler", _RUNS))):
        found = pattern.search(s) if (_may_run(s) if bit == 4 else mask >> bit & 1) else None
        if not found or bit == 4 and len(found[0]) < 0.5 * len(s):
            continue  # no match, or an ornament beside text
        if not pattern.search(QUOTED.sub(" ", s)):
            return "prose"
        if kind != "template" and _reports(s, words):
            return "prose"
        if kind == "filler" and len(words) >= 7 and _END.search(s) and 2 * sum(len(m[0]) for m in pattern.finditer(s)) < len(s):
            return "prose"  # a sentence about filler
        if kind in ("error", "script") and not _speaks(kind, s, words, [m[0] for m in pattern.finditer(s)]):
            return "weak"
        return kind
    if _CJK.search(s):
        return "prose" if len(s) >= 12 and (_END.search(s) or len(s) >= 30) else "neutral"
    return "prose" if len(words) >= 6 or (_END.search(s) and len(words) >= 4) or len(s) > 80 else "neutral"


def assess(text: str | None) -> tuple[str | None, float]:
    """(kind, density) of a text: kind is the residue kind with most characters, None where the text isn't residue.

    Density is that of residue texts; others, null and blank ones among them, have 0.
    """
    if text is None or not text.strip():
        return None, 0.0
    size = {"template": 0, "filler": 0, "error": 0, "script": 0, "prose": 0, "symbols": 0, "weak": 0}
    free: list[int] = []
    body = outside_code(text)
    size["prose"] += len(text) - len(body)
    known = bool(_NAMED.search(body))
    hopeless = (1 - DENSITY) * len(text)  # with more prose than this, no residue in the rest can reach the density
    for segment in _SPLIT.split(_TAG.sub("\n", body)):
        if not segment:
            continue
        verdict = judge(segment, known)
        n = len(segment.strip())
        if verdict == "neutral":
            free.append(n)
        elif verdict not in ("empty", "menu"):
            size[verdict] += n
            if size["prose"] > hopeless:
                break
    if size["prose"] > hopeless:
        return None, 0.0
    size["error" if size["error"] or size["script"] else "prose"] += size["weak"]
    size["prose"] += sum(sorted(free)[: max(0, len(free) - FREE_LINES)])
    if size["symbols"] and not size["prose"]:
        size["filler"] += size["symbols"]  # symbols alone fill a text; beside prose they are only ornament
    residue = sum(size[k] for k in ("template", "filler", "error", "script"))
    if not residue:
        return None, 0.0
    density = residue / (residue + size["prose"])
    if density < DENSITY:
        return None, 0.0
    return max(("template", "filler", "error", "script"), key=lambda k: size[k]), density


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, density) of every row; ``kind`` is null where the text isn't residue.

    Runs in the rows' own partitions, no shuffle. Defined cases: null, empty and blank texts have kind null and
    density 0; a text of any length is read whole; repeated rows and null keys are kept; an empty table gives no
    rows; extra columns are dropped.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [assess(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in verdicts], pa.string()), pa.array([v[1] for v in verdicts], pa.float64())], names=[key, "kind", "density"])

    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, kind string, density double")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind and density of every document."""
    return find_residue(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").withColumn("density", F.round("density", 4))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to exclude: the text as a whole is residue."""
    return find_residue(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").where("kind IS NOT NULL").select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_kinds": p10_kinds}
ORACLES: dict[str, str] = {}
