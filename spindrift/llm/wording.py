"""Words that errors, notices that scripts are needed, and filler are made of, and rules that tell such a sentence.

A sentence is judged by the roles of its words, not by its wording: which part
of its letters are words of the machine's or the site builder's vocabulary
(COVER), and whether among them is a combination that makes a message:

* a state that pages, servers and accesses fall into (error, forbidden,
  unavailable ...), or a weaker one (moved, missing, down ...) with a page,
  link, server ... that is in it;
* a denied verb of existence or ability (not found, cannot be displayed);
* scripts or cookies with needing, enabling or blocking them;
* filler: words of Latin dummy text; a placeholder or sample; text, copy or
  words that are to come; a request to the site's owner to write, edit or
  replace them; keys struck at random; one or two words over and over.

Little words (articles, pronouns, prepositions, politeness) count neither way.
A sentence with the vocabulary and without such a combination is ``weak``
(loading, redirecting, try again).  Chinese and Japanese, written without
blanks, are judged likewise by the strings they are made of.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from spindrift.functions.text import STOPWORDS

#: Part of a message's letters that must be vocabulary: in any sentence, and in one that recurs widely.
COVER, COVER_RECURRING = 0.88, 0.6
#: The same for a sentence that speaks to the reader or of the page itself, or that puts a thing of the site into a state in few words.
COVER_ADDRESSED = 0.65
FEW_WORDS = 6
_ADDRESS = set(
    """you your you're you've we our we're we've us sorry apologies oops please this these sie ihr ihre ihrer ihrem ihren wir bitte leider diese dieser diesem diesen dieses vous votre vos nous cette ce cet désolé désolée veuillez
    usted su sus esta este esto siento sentimos lamentamos вы вас вам ваш ваша ваше этот эта эту этой этому пожалуйста извините сожалению""".split()
)

_LITTLE = set(STOPWORDS) | set(
    """please may might must shall also yet still however us let lets got make made way thing something nothing anything someone some one like every much many
first well oh oops whoops ooops uh hmm sorry apologies apologize apologise hello hi dear thanks thank ok okay really maybe perhaps usually currently
der die das den dem des ein eine einen einem einer eines und oder ist sind war wird werden wurde wurden hat haben sie wir ihr ihre ihren ihrer ihrem es er ich du dein deine zu zum zur im in am an auf aus bei mit von vom für um bitte leider nur noch auch sich dass daß wenn ob wie was hier diese dieser dieses diesen dieser diesem derzeit können kann müssen muss möchten als nach durch über unter schon so aber damit
le la les l un une des du de d et ou est sont a ont été être il elle ils nous vous votre vos notre nos je tu ce cet cette ces qui que qu dans sur pour par avec en au aux se s veuillez svp désolé désolée ici actuellement peut peuvent doit y plus si mais cela c'est
el los las lo una unos unas y o es son ha han sido ser está están su sus tu tus nuestro nuestra este esta estos estas esto que en al del con por para se favor lo siento aquí actualmente puede pueden debe si pero más lamentamos
и в во на с со к ко по из за от до у о об для что это эта этот эти как ваш ваша ваше вы мы вас нас он она оно они или но а же бы чтобы если пожалуйста извините здесь сейчас был была было были есть его её их
il lo gli i un uno una dei delle della dello nel nella per con da di che non e è sono questa questo si o os as um uma do da dos das no na nos nas por favor não e é seu sua esta este
de het een en van op met voor is zijn te dat deze niet uw
either neither whether while since each both few lot lots bit quite very too already again yet about around else instead otherwise unless upon via per within along even ever always often sometimes
were had didn't doesn't don't isn't aren't wasn't weren't can't couldn't won't wouldn't shouldn't hasn't haven't that's it's we're you're they're i'm we've you've there's what's let's here's going believe believes think thinks
selbst gerade eben wieder bereits dann da dort sein seine worden sei wäre sollte sollten wollen will möglicherweise eventuell momentan gegebenenfalls etwas nichts alle alles jetzt mal ja
n'est n'a n'ont n'existe n'avez qu'il s'est j'ai tout tous toute toutes rien même où donc ainsi alors déjà encore après avant très bien vers celui celle
nada todo todos toda todas ya también donde cuando como muy sobre hasta desde entre aunque porque quizás tal vez ello esto eso esa ese usted ustedes hemos podemos podido poder podrá
при под над через после перед уже ещё еще только тоже также то так там тут где когда того этого этой этом такая такой такую такое которую которая который которые может можете возможно должен должна должно сожалению больше вам вами всё все наш наша наше
oups hoppla ups vaya mince wegen mehr seit trotz weil à pouvez pouvons voulez oui vous-même
dies heute einmal ganz ihnen euch euer eure ceci propio propia propre eigenen eigene eigener этому этим этих быть быв своего своим kein keine keinen keiner jede jeder jedes jeden worden wäre sei stets sowie у меня нет anymore devez doivent devons sentimos siento lamentamos lamento tiene tienes tienen tengo avez avons haben hat have has tun tut leid désolés désolées
ma anche più già qui quel quella ao à pelo pela mas mais já aqui ook maar wordt kan naar""".split()
)

_DENIED = re.compile(r"(?:not|no|cannot|cant|never|without|nicht|kein\w*|ohne|ne|n|pas|aucune?|sans|no|sin|ningun\w*|не|нет|без|non|não|niet|geen|\w+n['’]t|none|unable|neither|nor|ni)$")


def _words(text: str) -> re.Pattern:
    """A pattern for whole words; a star stands for any ending."""
    return re.compile("(?:" + "|".join(re.escape(w).replace(r"\*", r"\w*") for w in dict.fromkeys(text.split())) + ")$")


#: States that make a message by themselves.
_STATE = _words(
    """error errors forbidden unauthorized unauthorised unavailable inaccessible timeout timeouts denied refused expired suspended unsupported maintenance exception exceptions *exception *error traceback segfault
fatal aborted overflow uncaught unhandled overloaded unreachable malformed critical deprecated misconfigured outage offline captcha throttled blacklisted wrong
fehler* nichtverfügbar verweigert* gesperrt* wartung wartungsarbeiten abgelaufen* unerlaubt* serverfehler unerreichbar verboten störung
erreur* indisponible* introuvable* refusé* interdit* expiré* inaccessible* maintenance
error* inaccesible* denegad* prohibid* caducad* expirad* mantenimiento indisponib* suspendid*
ошибк* недоступ* запрещ* отказан* истек* обслуживани* ненайден* заблокирован* просрочен*
errore proibit* negat* manutenzione indisponível manutenção erro negado fout onbereikbaar storing onderhoud
unavailability unserviceable unresponsive unrecoverable unresolved unsuccessful misbehaving stacktrace backtrace coredump segfaulted nullpointer* syntaxerror typeerror downtime paywall geoblocked throttling panic
abgebrochen* untersagt* überlastet* fehlercode offline laufzeitfehler wartungsmodus zeitüberschreitung
inaccessibles défaillance dépassé saturé panne délai
inexistente* sobrecargad* agotado fallo avería
неполадк* сбой сбоя перегружен* таймаут исключени* несуществующ*
exceeded expiry insufficient unverified uninitialized uninitialised unspecified undefined unlicensed
abgelaufen nicht-verfügbar ausgefallen
caducó expiró bloqueado истекла истек истекло"""
)
#: States that need something of the site that is in them.
_MISHAP = _words(
    """moved removed deleted gone broken missing failed many excessive unusual fails failure failing fail down closed invalid bad exceeded rejected reset aborted dropped disabled blocked limited restricted protected private withdrawn
discontinued disappeared vanished lost stopped crashed dead unexpected unknown incorrect insecure untrusted outdated incompatible internal temporarily busy interrupted problem problems issue issues trouble snag glitch inactive unpublished unlisted nonexistent unconfigured configured limit
entfernt gelöscht verschoben defekt fehlt fehlgeschlagen ungültig* falsch deaktiviert* geschlossen unbekannt* veraltet problem* umgezogen vorübergehend gesperrt interner
supprimé* déplacé* cassé* manquant* échoué échec invalide* désactivé* fermé* inconnu* problème* interne temporairement
eliminad* movid* borrad* rot* falta falló inválid* desactivad* cerrad* desconocid* problema* intern* temporalmente
удален* удалён* перемещен* перемещён* сломан* отсутствует неверн* отключен* отключён* закрыт* неизвестн* проблем* внутренн* временно недействительн* устарел*
spostat* rimoss* scadut* removid* movid* expirou verwijderd verplaatst
renamed relocated retired archived obsolete unpaid overdue bounced corrupt corrupted damaged faulty empty mistake mistaken faults fault undefined unresponsive slow flooded hacked infected unsafe unstable crash dumped
restriction restrictions prevented prevents stopped halted interruption broke breaks lacking lack conflict mismatch overload exhausted violation suspicious banned ban limited rate exceeded exceed exceeds revoked locked unlock bug hiccup
abgelehnt überschritten unterbrochen verloren beschädigt ausgefallen umbenannt
renommé* retiré* perdu* limité* restreint* bloqué* dépassé* erroné* mauvais* hors
renombrad* retirad* perdid* limitad* restringid* bloquead* excedid* erróne* caíd*
переименован* потерян* ограничен* заблокирован* превышен* поврежден* ошибочн* нерабоч*"""
)
#: What of a site can be in a state.
_SITE = _words(
 """page pages site sites website websites webpage url urls address link links file files document documents resource resources content contents server servers service services gateway proxy database host hostname
domain domains connection connections session sessions user users username account accounts access permission permissions privilege privileges right rights browser browsers cookie cookies javascript script scripts
scripting app apps application applications system systems http https ssl tls certificate dns ip request requests requested response responses operation action command query queries code id ids reference ray incident ticket
administrator admin webmaster owner support helpdesk store shop search homepage startpage frontpage landing screen setting settings security plugin plugins extension extensions addon module component software
version network internet web upstream backend cluster node api endpoint method parameter token login password credentials form upload download directory folder path route location article post posts
product item entry record listing listings profile video image media player viewer feature function functionality quota traffic memory stack thread process runtime null pointer undefined index range 
column module main object string key argument call handler root localhost nginx apache iis tomcat cloudflare varnish wordpress php java python mysql sql firewall robot robots bot bots human region country area section platform tool
seite seiten webseite website adresse datei dokument inhalt* dienst verbindung sitzung benutzer konto zugriff zugang browser anwendung anfrage link ressource datenbank startseite administrator berechtigung* skript* webauftritt angeforderte* angefragte* gewünschte* aufgerufene*
page pages site adresse fichier document contenu ressource serveur service connexion session utilisateur compte accès navigateur application requête lien base données accueil administrateur autorisation droits demandé* demandée recherchée recherché
página sitio dirección archivo documento contenido recurso servidor servicio conexión sesión usuario cuenta acceso navegador aplicación solicitud enlace base datos inicio administrador permiso* solicitad* buscad* busca
страниц* сайт* адрес* файл* документ* содержим* ресурс* сервер* служб* сервис* соединени* сесси* пользовател* аккаунт* доступ* браузер* приложени* запрос* ссылк* базы данных прав* администратор* запрошенн* запрашиваем* раздел*
pagina risorsa collegamento indirizzo richiesta richiesto servizio página recurso endereço ligação procurada solicitada servidor serviço toegang pagina adres
functionality data database databases location locations destination information info details detail automation execution process processes processing web client clients customer hosting provider hoster infrastructure instance queue cache cdn edge
downloads uploads attachment archive preview image embed iframe tab console debugger devtools dns ports socket pipe packet disk storage filesystem permission directory index syntax parameter parameters argument arguments property properties variable undefined array offset token tokens statement expression
input output format header headers body payload cluster worker job transaction trace dump core segmentation allowed size bytes limit request uri route routing document documents homepage navigation sitemap shop forum blog thread comment comments member members subscription subscriber plan organization organisation policy
seiteninhalt* webserver nutzung rechte url internetseite internetadresse anmeldung daten verzeichnis support shop
internet données répertoire url réseau informations
datos directorio red información cuenta url
данны* каталог* сети сеть информац* учетн* запис* url
directories listing certificates store shops internet webpages remote listing listings author seller blog internetpräsenz homepage webpräsenz auftritt dienste theme themes bandwidth"""
)
#: Verbs of existence and ability, which count when denied.
_BEING = _words(
    """access accessing reach entry found find finding exist exists existing available accessible displayed display shown show reached reach loaded load connect connected opened open allowed permitted permit authorized authorised entitled responding respond responded answer work works working locate located process processed complete completed
handle handled serve served resolved resolve fulfilled proceed verify verified established establish recognized recognised valid supported support permission privileges rights here view see
gefunden existiert existieren verfügbar erreichbar angezeigt gibt aufgerufen geladen geöffnet berechtigt erlaubt möglich unterstützt verarbeitet beantwortet vorhanden finden
trouvé* trouver existe existent disponible* accessible* affiché* afficher charger autorisé* permis possible fonctionne trouvons
encontr* existe existen disponible* accesible* mostrar cargar permitid* posible funciona hallar
найден* найти существу* доступ* отобраз* загруз* открыть работает разреш* возможно
trovat* esiste disponibil* encontrad* disponível existe gevonden bestaat beschikbaar
send sent sending receive received return returned deliver delivered retrieve retrieved fetch fetched render rendered establish start started join continue continuing match matched matching understood parse parsed identify identified satisfy satisfied perform performed execute executed
hosted published active online live up specified supplied provided given selected defined accept accepted acceptable
zugreifen anzeigen bereitgestellt bearbeitet ausgeliefert abgerufen
accéder consulter charge répond traité traitée joindre
acceder conect* respond* procesar procesad* alcanzar
получ* обработ* отвечает подключ* попасть
listed listing contents verified available anymore claimed healthy published added yet process processed reachable operational started
steht verfügung stehen antwortet reagiert
répond réponse répondre
responde contesta
прав просмотра доступна доступен доступны"""
)
_SCRIPT = _words("javascript js scripts scripting noscript clientside cookies cookie skript* scripts скрипт* яваскрипт jscript ecmascript webassembly webgl")
_SWITCH = _words(
    """need needs needed require requires required requiring requirement enable enabled enables enabling disable disabled activate activated active activating allow allowed allowing turn turned switch switched block blocked support supports supported unsupported run runs running work works must rely relies depends without off missing use uses accept
benötigt benötigen erforderlich aktivieren aktiviere aktiviert* aktivierte* deaktiviert* einschalten eingeschaltet* erlauben zulassen ausgeschaltet ausgeführt läuft funktioniert nötig voraus
activer activez activé* désactivé* nécessaire* nécessite requis autoriser autorisez fonctionne exécute
activar active activa activad* habilit* deshabilit* desactivad* necesit* requiere requerid* permitir permita funciona ejecuta
включ* отключ* необходим* требу* разреш* выключ* поддерж* нужен нужно выполня*
abilita* attiva* richiede necessario ative ativar habilite ativado inschakelen vereist
necessary essential mandatory enabling turning rely depend make order functionality full features javascript-enabled capable
notwendig voraussetzung zwingend verwendet nutzt setzt
utilise repose obligatoire
utiliza obligatori* necesari*
использу* обязательн*"""
)
#: What readers are asked to do, and how long things take.
_ASK = _words(
    """enable activate allow turn switch unblock reload refresh retry try trying tried again return returning go going goes back backwards contact click check checking wait waiting loading load redirect redirecting redirected
forward sign signin log logged login logging register update updating upgrade install continue continuing proceed view viewing see seeing seems visit visiting visitor visitors use using run running runs come comes soon later moment moments minute minutes second seconds
hour hours while shortly long longer few day days time times started start begin beginning stay stand hang press push key button following above below next previous new newer latest current modern different another other full fully properly correctly
experience possible able look looking looked seem hit trouvons asked ask typed type entered enter spelling mistyped spelled mean meant want wanted need needs needed require requires required happened happens happening occurred occur encountered met condition went gave give given take takes took taking persist persists continues tell inform notify report reported know
fix fixed fixing working resolve soon hard team technical difficulties difficulty inconvenience cause caused due reason reasons help assistance option options menu browse explore step steps order purpose content verifying verify verifies confirm
confirming ensure make sure secure safe safely human robot detected detect detects appear appears appeared attempt attempting attempted too many slow rate excessive unusual behind perform performing put good bad luck place places end dead far
aktualisieren neu laden erneut versuchen versuche später zurück kontaktieren klicken prüfen überprüfen warten moment augenblick sekunden minuten stunden weiter weitergeleitet anmelden nutzen verwenden anzuzeigen sehen anzeigen aufgetreten eingetreten technische* gesucht suchen vollständig besuchen fortzufahren wenden gegenwärtig bald wieder uhr rufen
actualiser recharger réessayer réessayez essayer plus tard retour revenir revenez retourner contacter cliquer cliquez vérifier vérifiez patienter attendre secondes minutes continuer connecter connexion utiliser voir afficher produite produit survenue technique* cherchez recherchez lire bientôt instant chargement redirection
actualizar actualice recargar recargue intentar intente intentarlo nuevamente nuevo más tarde volver vuelva regresar contactar haga clic verificar compruebe espere esperar segundos minutos continuar iniciar usar ver mostrar producido ocurrido técnic* buscando pronto momento cargando redirigiendo hora
обнов* перезагруз* попробу* попытк* повтор* позже снова вернуться вернитесь назад связаться обрат* нажм* проверь* подожд* секунд* минут* часов продолж* войти войдите использ* увидеть просмотр* отобраз* произошл* возникл* техническ* искали скоро момент загрузка перенаправл*
riprova ricarica torna aspetta tente novamente recarregue voltar aguarde opnieuw probeer terug
establishing capacity warning warnings alert notice attention caution achtung hinweis warnung avertissement avis aviso advertencia внимание предупреждение briefly notified notify serious severe major minor general shown handling patience patient right now current currently shot another chance idea data information followed following follow browsing browse browsed scheduled planned improve improving improvements upgrade upgrades upgrading online back up supplied specified given directly manually automatic automatically process before after
accessing access attempts attempts behalf end ends engineers engineer developers developer staff people working hard happening quickly asap shortly apologise apologies appreciate appreciated understand understanding support supported whoever link links looks like alternative alternatively search searching searched queried
nothing here zero result results match matches case sensitive letters uppercase typo typing bookmark bookmarks outdated address bar number code id attached incident logs log details logged believe mistake send message email mail phone call feel free question questions concern concerns
fetch fetching establish sending trying reaching reach refreshing restarting restart clear clearing close reopen reconnect disconnect reconnecting resume disable adblock adblocker vpn incognito private mode firewall antivirus
execution during occurred encountered additionally additional while using uses given handling error
überprüfung geduld verständnis danke vielen dank unannehmlichkeiten entschuldigen entschuldigung einstellungen vollen umfang funktionen gesuchte aufrufen hilfe grund gründen dauert geplante* arbeiten arbeiten eingegebene* richtig korrekt stimmt nochmal nochmals gehen gelangen
patience merci compréhension gêne occasionnée excuses raison travaux cours moments vérifié saisi saisie correctement nouveau aller page-là demande votre
paciencia gracias comprensión molestias disculpe disculpas motivo trabajos realizando proceso escrito correctamente ir ruego rogamos
терпение спасибо понимание неудобств* приносим извинения ведутся работы техническ* причин* введен* правильно набран* перейд* перейти помощ* времен* чуть скор* работу работы
playback verification attempt reload player side name goes find explore trouble anymore someone finds published publish publishes intentionally reaching reached reaches until tomorrow today yesterday midnight hourly daily free goes sends mean means working properly proper cleared clears
capacity bandwidth maximum minimum concurrent simultaneous extended brief ongoing upcoming recently recent last latest previously earlier original existing missing special individual certain various several general common typical regular normal usual unusual
authenticate authentication authenticity verified verification validate validation validated certificates trusted trust identity proof decline declined declines refuse refuses reject rejects policy policies terms violates violation abuse spam detect detection protect protection protecting firewalled
subscribe subscription renew renewal pay payment payments purchase purchased owner owners seller sellers author authors publisher creator manager moderator moderators staff operator operators webmasters hosted hosts remote local peer
killed restart restarted rebooting reboot booting starting launching launch initializing initialising preparing processing progress finished finish finishing done ready soon awaiting queue queued position estimated remaining
country countries location region locale language languages device devices desktop smartphone phone tablet edition apple android windows linux
melden anmelden einloggen verfügung ihrerseits kontaktdaten angemeldet ausgeloggt abgemeldet entsteht entstehen gleich augenblicken kurzer kürze länger dauern dauert gebeten versucht wählen gewählt stellen stehen nächste nächsten vorherige unten oben folgenden
reconnecter reconnectez instants quelques momentanément ultérieurement renouveler rendez suivant suivante précédent choisir ouvrir pays région langue droits
sesión inicie iniciado cierre reintente país región idioma siguiente anterior abrir elegir minutos rato brevedad encuentra encontramos
войдите истекл* просмотра просмотреть страну регион язык ожида* следующ* предыдущ* выбер* откро*"""
)
#: Filler: what is filled, what fills it, and what the owner of a site is asked to do.
_TEXT = _words(
    """text texts copy content contents paragraph paragraphs block blocks section sections words wording word line lines post page article headline heading title titles subtitle description descriptions story font fonts caption image images
space template theme layout site website blog blurb bio body area widget element box column column
text* absatz abschnitt inhalt* überschrift beitrag worte wörter schrift platz texte paragraphe titre contenu bloc texto párrafo título contenido bloque текст* абзац* заголов* testo paragrafo titolo tekst alinea
contenus inhaltes texten textes textos texts paragraphs webpage web"""
)
_FILLING = _words(
    """example examples placeholder placeholders dummy filler sample lorem ipsum mock mockup stub boilerplate blindtext platzhalter platzhaltertext mustertext beispieltext fülltext dummytext exemple factice remplissage ejemplo relleno provisional ficticio
рыба рыбный заполнитель пример образец segnaposto riempimento esempio exemplo voorbeeldtekst demo untitled unbenannt
coming construction beispielseite musterseite platzhaltertexte beispiel muster exemples ejemplos примера демо тестов* заглушк*"""
)
_FINAL = _words("real final actual finished finale endgültige* eigentliche* définitif définitive réel real final definitivo definitiva окончательн* настоящ*")
_COMING = _words(
    """come comes coming arrive arrives supplied follow follows added provided inserted later soon until here replace replaced ready folgt folgen ersetzt später steht stehen hier wird venir remplacer remplacé bientôt prochainement ici
pronto aquí próximamente reemplazar reemplazado aparecerá здесь скоро будет появится arrivo breve"""
)
_WRITE = _words(
    """fills füllt füllen remplit llena write writing edit editing delete replace replacing describe describing tell telling add adding change changing insert type enter introduce share fill fills filling customize customise update
schreiben schreibe bearbeiten bearbeite löschen lösche ersetzen ersetze beschreiben beschreibe ändern ändere écrire écrivez modifier modifiez supprimer remplacer décrivez décrire escribir escriba editar edite eliminar reemplace reemplazar describa
напишите измените удалите замените опишите отредактируйте scrivi modifica escreva edite

start starts put place paste upload choose select selecting click double customise customizing personalize personalise swap swapping overwrite
fügen füge einfügen hinzufügen hinzu eintragen tragen ajouter ajoutez remplacez insérer insérez saisissez personnalisez agregar agregue añadir añada reemplácelo reemplazarlo inserte escriba вставьте добавьте введите"""
)
_OWNER = _words(
    """people customers clients users visitors readers world business company team brand store shop product products service services offer offers what who your you yourself own about us story great first click double start begin starting beginning just some see how looks look
only easy easily feel free let know more place read nothing empty yet describe welcome mission demo test example created automatically default new font
settings theme readers get started who tell publish before new visitors"""
)
#: Latin dummy text.
_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum massa quam vel nibh eget porta orci urna fusce vivamus mauris donec vestibulum pellentesque
nullam nunc pretium tincidunt ante curabitur sagittis viverra lectus ultrices posuere cubilia curae sapien morbi tristique senectus netus malesuada fames ac turpis egestas proin pharetra nonummy integer feugiat scelerisque varius blandit praesent dapibus facilisis purus semper cursus risus gravida hendrerit vulputate suspendisse potenti maecenas luctus justo diam phasellus ultricies leo pulvinar aenean bibendum quisque consetetur sadipscing elitr diam eirmod invidunt aliquyam erat voluptua accusam duo dolores rebum stet clita kasd gubergren sea takimata sanctus arcu ligula aliquet tellus augue""".split()
)
_KEYS = re.compile(r"(?:(?:a?sdf+g?h?(?:jkl?)?|jkl|hjkl|fghj?|qwert[yz]?(?:uiop?)?|zxcv(?:bnm?)?|wasd|uiop|foo+|bar|baz|qux|foobar|bla+h?|blub|xyz|abc|aaa+|bbb+|tbd|tba|test\w?)|(\w)\1{2,}|(?:[xX]{2,}))$")

_CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾝ]+")
_CJK_STATE = re.compile(
    "不存在|未找到|找不到|没有找到|找不着|没有.{0,10}权限|无法|错误|出错|失败|拒绝|禁止|不可用|超时|过期|维护|没有权限|无权|无权限|繁忙|异常|重置|已删除|被删除|已失效|失效|不支持|被禁用|已禁用|中断|崩溃|故障|無法|錯誤|失敗|拒絕|維護|逾時"
    "|読み込めません|期限が切れ|切れました|見つかりません|見つからない|できません|できない|エラー|禁止されて|拒否|権限がありません|権限があり|利用できません|存在しません|メンテナンス|タイムアウト|無効|失敗しました|期限切れ|混み合って|混雑|障害|削除され|サポートされていません|許可されていません|アクセスできません|表示できません|ありません"
)
_CJK_SCRIPT = re.compile("启用|啟用|开启|打开|需要|必须|允许|禁用|支持|有効|オン|必要|許可|無効")
_CJK_FILL = re.compile("示例|占位|样例|测试文[字本]|假文|填充|ダミー|サンプル|仮の?(?:テキスト|文章|文)|プレースホルダー|テスト(?:テキスト|文)")
_CJK_VOCABULARY = re.compile(
    "|".join(
        sorted(
            """页面 网页 网站 站点 请求 文件 资源 服务器 服务 访问 链接 地址 内容 数据库 连接 网络 浏览器 用户 账户 账号 权限 系统 程序 应用 会话 登录 管理员 首页 主页 验证 安全 设置 本页 此页 该页 当前 暂时 内部 您 你 我们 的 了 此 该 这个 请 后 再 试 稍后 稍候 稍等 重试 刷新 返回 联系 查看 正在 加载 中 跳转 秒 重新 继续 使用 检查 输入 所 要 需 或 和 与 在 是 被 已 将 会 到 对不起 抱歉 很 非常 发生 出现 遇到 无 没有 可能 移动 删除 更名 改 过 文字 文本 正文 标题 图片 您的 才能 以 并 让 显示 看到 下 上 找 寻 访 问 開啟 頁面 伺服器 請 稍後 重新整理 您要 網頁 瀏覽器 替换 为 换成 更换 集中 予期しない 予期せぬ 能 不 未 可 就 都 也 还 已经 正常 信息 提示 代码 错 误 联 系 客服 技术 支持 页 打开 关闭 功能 资料 数据 状态 时间 分钟 小时 自动 确认 检 查
ページ サイト ウェブサイト サーバー サーバ リクエスト ファイル リソース サービス アクセス リンク アドレス コンテンツ データベース 接続 ネットワーク ブラウザ ブラウザー ユーザー アカウント 権限 システム アプリ セッション ログイン 管理者 ホーム トップ 内部 一時 的 に の を が は で と も へ や から まで より お 探し ご 覧 になる なる 見る 見 する した して ください 下さい いただき ます ました です でした は 、 しばらく 後 で 再度 もう一度 お試し お待ち 待ち 更新 再読み込み 読み込み 読み込んで 中 戻る 戻って 確認 設定 発生 現在 申し訳 ございません ありません されました され 移動 削除 可能性 あり ある この その 要求 指定 URL 表示 利用 テキスト 文章 文字 本文 タイトル 画像 入力 続ける 続行 ため には いる い た て し 時間 おいて 秒 自動 転送 予期 しない せぬ これ それ です だ あと これは ただいま 集中 おり 多く なって なりました 必要 続き 詳細 情報 有効期限 期限 切れ ログイン 情報 問題 起き 試して 試し みて 記事 投稿 掲載 予定 準備 中です な お り ん""".split(),
            key=len,
            reverse=True,
        )
    )
)

#: Roles as bits.
STATE, MISHAP, SITE, BEING, SCRIPT, SWITCH, ASK, TEXT, FILLING, FINAL, COMING, WRITE, OWNER, LITTLE, DENIED, KEYS = (1 << i for i in range(16))
_ROLES = (
    (STATE, _STATE), (MISHAP, _MISHAP), (SITE, _SITE), (BEING, _BEING), (SCRIPT, _SCRIPT), (SWITCH, _SWITCH), (ASK, _ASK), (TEXT, _TEXT), (FILLING, _FILLING), (FINAL, _FINAL), (COMING, _COMING), (WRITE, _WRITE), (OWNER, _OWNER), (DENIED, _DENIED), (KEYS, _KEYS),
)
_MACHINE = STATE | MISHAP | SITE | BEING | SCRIPT | SWITCH | ASK
_BUILDER = TEXT | FILLING | FINAL | COMING | WRITE | OWNER | ASK | SITE


@lru_cache(maxsize=1 << 17)
def roles(word: str) -> int:
    """The roles of a lower-case word."""
    out = LITTLE if word in _LITTLE else 0
    for bit, pattern in _ROLES:
        if pattern.match(word):
            out |= bit
    return out


#: What a sentence can be; ``BLAND`` is of the site builder's vocabulary without a combination.
OWN, WEAK, MESSAGE, BLAND = 0, 1, 2, 3
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Several words that are one, and elided articles and negations.
_ONE = (
    (re.compile(r"\bjava\s+script"), "javascript"),
    (re.compile(r"\bclient[\s-]+side\b"), "clientside"),
    (re.compile(r"\b(?:timed?|times|timing)[\s-]+out\b"), "timeout"),
    (re.compile(r"\b(?:run|ran|runs|logged|signed)\s+out\b"), "expired"),
    (re.compile(r"\bno\s+(?:longer|more)\b"), "not"),
    (re.compile(r"\b([cdjlmnst]|qu)['’](?=\w)"), r"\1 "),
)


_ANY_ONE = re.compile(r"java\s|client[\s-]|\sout\b|-out\b|\bno\s|['’]")


def tokens(sentence: str) -> list[str]:
    if _ANY_ONE.search(sentence):
        for pattern, word in _ONE:
            sentence = pattern.sub(word, sentence)
    return _TOKEN.findall(sentence)


@dataclass(frozen=True)
class Judgement:
    """A sentence's kind, its kind if it recurs widely, its letters (little words apart), and how many of them aren't vocabulary."""

    kind: int
    wide: int
    letters: int
    unknown: int


def _cjk(sentence: str) -> Judgement:
    flat = "".join(_CJK.findall(sentence))
    latin = tokens(_CJK.sub(" ", sentence))
    script = any(roles(w) & SCRIPT for w in latin)
    made = bool(script and _CJK_SCRIPT.search(flat) or _CJK_STATE.search(flat) or _CJK_FILL.search(flat))
    left = _CJK_VOCABULARY.sub("", _CJK_SCRIPT.sub("", _CJK_FILL.sub("", _CJK_STATE.sub("", flat))))
    n = max(len(flat) + sum(map(len, latin)), 1)
    unknown = len(left) + sum(len(w) for w in latin if not roles(w))

    def kind(least: float) -> int:
        return OWN if 1 - unknown / n < least else MESSAGE if made else WEAK

    return Judgement(kind(COVER), kind(COVER_RECURRING) if made else kind(COVER), n, unknown)


def judge(sentence: str, words: list[str] | None = None) -> Judgement:
    """Judges a lower-case sentence without numbers and addresses."""
    if not sentence.isascii() and _CJK.search(sentence):
        return _cjk(sentence)
    words = tokens(sentence) if words is None else words
    if not words:
        return Judgement(WEAK, WEAK, 0, 0)
    each = [roles(w) for w in words]
    letters = known = machine = builder = keys = every = 0
    for w, r in zip(words, each):
        every |= r
        if r & KEYS:
            keys += len(w)
        if r & (LITTLE | DENIED):
            continue  # they count neither way
        letters += len(w)
        known += len(w) * bool(r)
        machine += len(w) * bool(r & _MACHINE)
        builder += len(w) * bool(r & _BUILDER)
    latin = sum(w in _LATIN for w in words) >= 0.6 * len(words) and any(w in _LATIN and not r for w, r in zip(words, each))
    over = len(words) >= 3 * len(set(words)) and len(set(words)) <= 2
    if latin or over or keys >= 0.8 * sum(map(len, words)):
        return Judgement(MESSAGE, MESSAGE, max(letters, 1), 0)
    denied = bool(every & DENIED)
    made = bool(every & STATE) or bool(every & MISHAP and every & SITE) or bool(denied and every & BEING) or bool(every & SCRIPT and (every & SWITCH or denied))
    texts = len({w for w, r in zip(words, each) if r & TEXT})
    # what a site builder says of a page that isn't there yet
    fills = bool(every & FILLING and len(words) >= 2) or bool(every & FINAL and texts and every & COMING) or bool(every & WRITE and every & OWNER and (texts or every & SITE or len(words) >= 4))
    fills = fills or builder >= letters and (texts >= 2 or bool(texts and every & COMING and len(set(words)) <= 6))
    ratio = max(machine if made else 0, builder if fills else 0) / max(letters, 1)

    addressed = not _ADDRESS.isdisjoint(words) or bool(every & STATE and every & SITE) and sum(not r & (LITTLE | DENIED) for r in each) <= FEW_WORDS

    def kind(least: float) -> int:
        if (made or fills) and ratio >= (min(least, COVER_ADDRESSED) if addressed else least):
            return MESSAGE
        return WEAK if machine >= letters else BLAND if builder >= letters else OWN

    return Judgement(kind(COVER), kind(COVER_RECURRING), letters, letters - known)
