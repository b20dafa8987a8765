"""Wordings of messages, slots and content, written from memory of public software and sites; none of them is a rule.

The rules' vocabulary was widened after looking at what they missed of the first set.  The last set was written when
the rules stood, and measured before anybody looked at what it missed (README).
"""

MESSAGES = """JavaScript must be enabled in order for you to use this site.
This site requires JavaScript to function properly.
404 - File or directory not found. The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable.
Error 503 Backend fetch failed
Access to this page has been denied.
The page cannot be displayed
Sorry, the page you are looking for doesn't exist.
Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
Pagina non trovata
You need to enable JavaScript to run this app.
We're sorry but this application doesn't work properly without JavaScript enabled. Please enable it to continue.
For full functionality of this site it is necessary to enable JavaScript.
Your browser does not support JavaScript!
JavaScript is required to view the contents of this page.
Please turn on JavaScript in your browser settings and reload the page.
It looks like your browser has JavaScript disabled.
Enable JavaScript and cookies to continue
This page uses JavaScript. Your browser either doesn't support JavaScript or you have it turned off.
Checking your browser before accessing the website. This process is automatic. Your browser will redirect to your requested content shortly.
Please allow cookies and scripts for this domain to proceed.
The requested URL was not found on this server. That's all we know.
Not Found. The requested URL /index.html was not found on this server. Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request.
Oops! That page can't be found. It looks like nothing was found at this location.
HTTP Error 404. The requested resource is not found.
This page isn't working right now. The site didn't send any data.
This site can't be reached. The server took too long to respond.
Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.
We couldn't find the page you were looking for.
The document you requested has been moved or deleted.
The content you are trying to view is no longer available.
Unable to connect to the server. Please try again later.
500 - Internal server error. There is a problem with the resource you are looking for, and it cannot be displayed.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
502 Bad Gateway. The proxy server received an invalid response from an upstream server.
504 Gateway Time-out. The server didn't respond in time.
Application error: a client-side exception has occurred. See the browser console for more information.
An unhandled exception occurred during the execution of the current web request.
Error establishing a database connection
There has been a critical error on this website.
Briefly unavailable for scheduled maintenance. Check back in a minute.
We are currently performing maintenance. We will be back soon.
Site under maintenance. Thank you for your patience.
Too many requests. You have been rate limited. Try again in a few minutes.
Access denied. You don't have permission to access this resource.
403 Forbidden. You do not have permission to view this directory or page using the credentials that you supplied.
Your session has timed out. Please log in again.
Your IP address has been blocked by the administrator.
This content is not available in your country.
Sorry, you have been blocked. You are unable to access this website.
Please verify you are a human. Access to this page has been denied because we believe you are using automation tools to browse the website.
This account has been suspended. Contact your hosting provider for more information.
This store is unavailable.
Your connection is not private. Attackers might be trying to steal your information.
The requested page is invalid or has expired.
Fatal error: Allowed memory size exhausted
Warning: mysql_connect(): Access denied for user
Parse error: syntax error, unexpected end of file
Uncaught TypeError: Cannot read property of undefined
NullPointerException at main thread
Segmentation fault (core dumped)
No input file specified.
File not found.
The link you followed has expired.
Invalid request. Bad parameters.
Something went wrong. Don't fret, let's give it another shot.
Oops, something broke on our end. Our team has been notified.
An unexpected error has occurred. Reference number attached.
The service you requested is restricted.
You must be logged in to view this page.
Sorry, but you are not authorized to view this content.
This video is unavailable.
The page you requested could not be loaded.
Error loading page. Please refresh.
Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat.
This is a sample page. Replace this text with your own content.
I'm a paragraph. Click here to add your own text and edit me. It's easy.
This is placeholder text. It will be replaced by the final copy.
Dummy text for this section. Dummy text for this section.
Your content goes in this block. Edit this text to describe your product.
Use this area to introduce your company to new visitors.
Sample text. Click to select the text box. Click again or double click to start editing the text.
Content coming soon.
Page under construction
Our new website is coming soon.
test test test test test
asdf asdf asdf qwerty
Hello world! This is an example post.
Add a description of this item here.
Diese Seite existiert leider nicht.
Die von Ihnen aufgerufene Seite konnte nicht gefunden werden.
Fehler 404 - Seite nicht gefunden. Bitte überprüfen Sie die Adresse.
Zugriff verweigert. Sie haben keine Berechtigung, diese Seite anzuzeigen.
Wegen Wartungsarbeiten ist die Webseite derzeit nicht erreichbar.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite nutzen zu können.
Für die Nutzung dieser Anwendung wird JavaScript benötigt.
Der Server ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut.
Dies ist ein Beispieltext. Hier steht später der endgültige Inhalt.
Ein technischer Fehler ist aufgetreten.
Cette page n'existe pas ou a été supprimée.
Erreur 404 : la page que vous recherchez est introuvable.
Vous n'avez pas l'autorisation d'accéder à cette page.
Le site est actuellement en maintenance. Veuillez réessayer plus tard.
Vous devez activer JavaScript dans votre navigateur pour afficher cette page.
JavaScript est désactivé dans votre navigateur.
Une erreur s'est produite. Veuillez actualiser la page.
Ceci est un texte d'exemple. Remplacez-le par votre contenu.
La página solicitada no existe.
Lo sentimos, no se ha encontrado la página que está buscando.
Error 404: página no encontrada
No tiene permiso para acceder a este recurso.
Se ha producido un error interno en el servidor. Inténtelo de nuevo más tarde.
Sitio en mantenimiento. Vuelva pronto.
Debe habilitar JavaScript en su navegador para usar esta aplicación.
Este es un texto de ejemplo. Reemplácelo por su propio contenido.
Запрашиваемая страница не найдена.
К сожалению, такой страницы не существует.
Ошибка 404. Страница удалена или перемещена.
Доступ к этому ресурсу запрещён.
Сайт временно недоступен. Ведутся технические работы.
Для работы сайта необходимо включить JavaScript в браузере.
Произошла ошибка сервера. Попробуйте позже.
Здесь должен быть ваш текст. Это пример текста.
抱歉，您访问的页面不存在。
404 页面未找到
服务器繁忙，请稍后再试。
您没有访问该页面的权限。
网站正在维护中，请稍后访问。
您的浏览器已禁用 JavaScript，请开启后继续。
系统发生错误，请联系管理员。
这是示例文字，请替换为您的内容。
お探しのページは存在しません。
指定されたファイルが見つかりません。
アクセスが集中しており、ページを表示できません。
このページを表示する権限がありません。
ただいまメンテナンス中です。しばらくお待ちください。
このサイトを利用するには JavaScript を有効にする必要があります。
予期しないエラーが発生しました。もう一度お試しください。
これはダミーテキストです。
Sorry, we can't find that page. You'll find lots to explore on the home page.
Hmm. We're having trouble finding that site. We can't connect to the server.
Secure Connection Failed. An error occurred during a connection. The page you are trying to view cannot be shown because the authenticity of the received data could not be verified.
The connection has timed out. The site could be temporarily unavailable or too busy. Try again in a few moments.
Your internet connection appears to be offline.
No webpage was found for the web address.
Bandwidth Limit Exceeded. The server is temporarily unable to service your request due to the site owner reaching his bandwidth limit.
Directory listing denied. This virtual directory does not allow contents to be listed.
The website declined to show this webpage. This website requires you to log in.
Index of this directory is forbidden.
Whoa there! Your request has been blocked due to a network policy.
Our servers are over capacity right now. Please try again in a moment.
We'll be right back. Our store is down for scheduled maintenance.
The application failed to respond. If you are the application owner check your logs for details.
Domain not claimed. This domain is not connected to a website yet.
Your browser is no longer supported. Please upgrade to a modern browser.
To use this page you must have JavaScript turned on.
Cookies must be enabled to use this website.
This module needs JavaScript. Turn it on and refresh.
Script execution is blocked on this page. Enable scripts to view the content.
The URL you entered is incorrect or the page no longer exists.
Object not found! The requested URL was not found on this server. If you entered the URL manually please check your spelling and try again.
Server Error in Application. Runtime Error. Description: An application error occurred on the server.
Could not open input file.
Undefined variable in template on line 12
Connection refused by remote host
Out of memory: killed process
You have been logged out. Please sign in to continue.
We could not process your request. Please contact support.
The item you requested is not available anymore.
This listing has been removed by the seller.
This post was deleted by its author and is no longer available.
This page has been intentionally disabled by the administrator.
You have reached your limit of free requests. Please wait until tomorrow.
Rate limit exceeded, retry later.
Security check failed. Access blocked.
This is a default page. Replace this file with your own index page.
Default web page of this server. The web site administrator has not added content yet.
Test page for the web server. If you can read this page it means that the server is working properly.
Your new blog is ready. Edit this page to get started and tell your readers who you are.
This is where your text goes. Change it in the settings of the theme.
Filler paragraph. Filler paragraph. Filler paragraph.
Add your description in this block before you publish the page.
Text to follow.
Die angeforderte URL konnte auf dem Server nicht gefunden werden.
Ihr Browser unterstützt kein JavaScript oder es ist deaktiviert.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Hier entsteht eine neue Internetpräsenz.
Der Dienst steht momentan nicht zur Verfügung.
Votre session a expiré. Veuillez vous reconnecter.
Le serveur ne répond pas. Réessayez dans quelques instants.
Contenu indisponible dans votre pays.
Su sesión ha caducado. Inicie sesión de nuevo.
El servidor no responde en este momento.
El contenido que busca ya no está disponible.
Сессия истекла. Войдите снова.
Сервер не отвечает, повторите попытку позже.
У вас нет прав для просмотра этой страницы.
该链接已失效或文件已被删除。
数据库连接失败，请稍后重试。
ページの有効期限が切れました。再度ログインしてください。
サーバーに接続できませんでした。
The requested page could not be found.
You are not authorized to access this page.
The website encountered an unexpected error. Please try again later.
This is not the web page you are looking for.
Sorry, nobody on our side goes by that name. The page you were looking for does not exist.
This site is currently private. Log in to get access.
This account doesn't exist. Try searching for another.
Looks like this page is missing. Go back to the homepage.
The specified key does not exist.
Request could not be satisfied. We can't connect to the server for this app or website at this time.
Upstream connect error or disconnect before headers. Reset reason: connection failure
No healthy upstream
Your access to this service has been temporarily limited.
This domain has expired. Is this your domain? Renew it now.
Website coming soon. Please check back soon to see if the site is available.
This site is blocked by the network administrator.
The file you are looking for has been removed by the user.
Playback error. Reload the player.
Too many redirects occurred trying to open this page.
Your browser sent a request that this server could not understand.
The security token is missing from your request.
CSRF verification failed. Request aborted.
Invalid session. Please refresh the page.
Method not allowed for this endpoint.
Payment required to view this content.
Please upgrade your browser to use this site.
You appear to have JavaScript turned off. Some features will not work without it.
JavaScript required. Sorry, the viewer needs it to run.
This form needs scripts. Please allow them for this site.
Activate cookies to sign in.
Attempt to read property on null in file on line
Stack overflow in thread main
Database query failed: table does not exist
Permission denied while opening socket
Lorem ipsum text goes into this box.
Dummy headline for this section
Replace this sample description with a short story about your shop.
This is example content. You can edit or delete it at any time.
Body copy to be added.
Zu Ihrer Suche wurde leider keine Seite gefunden.
Der Zugriff auf diese Datei ist nicht erlaubt.
Wir arbeiten gerade an der Webseite und sind bald wieder da.
JavaScript muss aktiviert sein, damit diese Seite funktioniert.
La ressource demandée n'est plus disponible.
Accès interdit. Vous devez vous connecter.
Esta página ya no está disponible. Vuelva al inicio.
Acceso denegado. Inicie sesión para continuar.
Страница, которую вы ищете, была удалена.
Включите поддержку JavaScript для просмотра сайта.
无法访问此网站。连接已重置。
ページを読み込めませんでした。もう一度お試しください。""".split("\n")

SLOTS = """Hello %NAME%, welcome
Hi {0}, your order {1} shipped
[PLACEHOLDER]
Enter your text here.
Dear {firstname}, thank you for your purchase.
Dear [Customer Name], we are writing to you about your account.
Hello <first name>, your invoice is ready.
*|FNAME|*, see what is new this week
Welcome, {{ user.first_name }}!
Hi ${customerName}, thanks for joining us.
Copyright [year] [company name]. All rights reserved.
Insert your text here
Your headline here
[Insert image here]
Contact us at [email address] or [phone number].
Published on {date} by {author}
{% company_name %} was founded in the spring.
[Your Name]
Type your message here
Write your introduction here.
Add text here
<INSERT TITLE>
TODO: add description
TBD: final opening hours
FIXME: replace this paragraph before launch
<%= product.title %> is now in stock.
Meet ##CITY## this summer.
[TEXT]
Best regards, [Signature]
Ihr Text hier
Hallo [Vorname], willkommen zurück.
[Insérez votre texte ici]
Bonjour {prenom}, votre commande est prête.
[Inserte su texto aquí]
Subtitle goes here
Image caption goes here
$FIRSTNAME, your weekly digest
Hi {{{customer.name}}}!
@@PRODUCT_NAME@@ ships free
Sent from __CITY__ with care
Hi [First Name], your table is booked.
Dear {{customer_name}}, thanks for your visit.
Hello {user_name}!
[Insert logo here]
Your company name here
Enter your email text here
%FIRST_NAME%, we miss you
TODO: insert map
Written by {author_name} on {publish_date}
[Company Name] is proud to present its new boat.
Hi {{{name}}}, click below
Paragraph text goes here
[Add a caption]
Bonjour [prénom], merci de votre visite.
Estimado [nombre], gracias por su pedido.
##order_number## has been shipped
Good morning {first_name}, your parcel is on its way.
[Insert company logo]
Hello [Name of customer],
Your subtitle here
{{ site.title }} - official site
Posted by {user} in {category}
TODO: rewrite this section
Enter a short description here
%%EMAIL%% is on our list
[Your City], [Your Country]""".split("\n")

CONTENT = """The museum keeps a page from the 1611 edition under glass, and visitors may turn it on Sundays.
Errors in the tide tables were common before the harbour bought its own clock.
A missing page in the ledger was found behind the stove in 1932.
The council denied access to the quay after the storm, and the boats stayed in the river.
Service on the mountain line is suspended every winter when snow closes the pass.
The bridge is closed for maintenance until May, so the bus takes the valley road.
Our guide explains how to enable JavaScript in five browsers and why you may not want to.
When a server returns 404, the crawler writes the address to a list and moves on.
The word error comes from the Latin verb for wandering.
If your cookies come out too hard, check the temperature of the oven and bake them for a shorter time.
The script of the play was lost for two centuries and found in a Lisbon attic.
Actors need a script they can trust, and this one requires patience.
Please wait at the blue door; a warden will take you to the reading room.
The gateway to the old town was rebuilt after the fire of 1702.
The restaurant is temporarily closed while the kitchen is painted.
Lorem ipsum is a scrambled passage from Cicero that printers have used since the sixteenth century.
In typography, placeholder text fills a page so that a client looks at the design and not at the words.
Access control lists say which user may read which file; a rule that denies comes before one that allows.
HTTP status 503 tells a client that a service is unavailable; the Retry-After header says when to come back.
The 403 bus runs from Forbidden Hill to the station every ten minutes.
A template engine replaces each variable with its value before the page reaches a reader.
Write the title on the first line, your name below it, and leave the rest blank for the teacher.
The domain of the function is the set of all numbers for which it is defined.
The permission slip must be signed by a parent before the trip to the lake.
Connection times at the junction are tight, and a late train means an hour on the platform.
Not found in any other valley, the orchid flowers for a week in June.
The server brought two bowls of soup and apologised for the delay.
Loading the wagons took until dusk; the horses were fed at the mill.
Bad weather kept the ferry in port, and the island had no bread for three days.
Invalid ballots were counted twice and kept in a sealed box.
She could not find the address, so she asked at the post office.
The library does not exist any more, but its catalogue does.
We tested forty sites without scripts; nine showed nothing at all.
A timeout was called with two minutes left, and the home side changed its keeper.
This paragraph describes the geology of the northern coast.
The sample was taken from a block of marble near the old section of the wall.
Our company offers tours of the salt mine for groups of ten and more.
The first post on this road was set in 1811 and replaced in 1903.
Example: the sum of the first ten odd numbers is one hundred.
The test of the new engine took four days and ended without a fault.
Real copy paper is heavier than the text block of the book suggests.
Die Seite des Hauses, die zum Fluss zeigt, wurde im Krieg beschädigt.
Der Fehler lag in der Rechnung, nicht in der Waage.
Wegen Bauarbeiten fährt der Zug heute nur bis zum Markt.
In der alten Mühle wurde der Zugang zum Keller erst spät gefunden.
Für das Rezept werden drei Eier und ein Glas Milch benötigt.
La page la plus ancienne du registre date de 1542.
Le service commence à sept heures et la cuisine ferme à minuit.
L'erreur du capitaine coûta deux navires à la compagnie.
Il faut activer la levure dans un peu d'eau tiède avant de pétrir.
La página más antigua del libro está en la vitrina del museo.
El error del mapa llevó a los barcos hasta la otra orilla.
El acceso al castillo se hace por el puente del norte.
No hay tren los domingos, pero el mercado abre todo el día.
Ошибка в карте стоила экспедиции двух недель пути.
Доступ к реке открыт только с северного берега.
Страница из старой книги висит в рамке над столом.
Музей закрыт по понедельникам, а сад открыт каждый день.
这座桥在1950年以后禁止马车通行。
博物馆的第一页手稿放在二楼的玻璃柜里。
火车站旁边的服务中心今天关门，请到市场买票。
错误的地图让船队多走了三天。
この橋は冬のあいだ通れませんので、川沿いの道をお使いください。
古い地図の誤りが見つかり、港の名前が直されました。
博物館の庭は月曜日に閉まっています。
手紙の最初のページは失われたと考えられている。
Use `document.write` only before the page has loaded; afterwards it removes what is there.
The function raises a ValueError if the list is empty, so check its length first.
Catch the exception, write it to the log and return an empty list to the caller.
The error rate fell from four to two percent after the second training run.
In mathematics {0} is the smallest ring, and every ring has a map to it.
The set {a, b} has four subsets.
Write {{name}} in `double braces` and the engine fills in the value, the manual says.
Prices in this list are in [EUR] unless marked otherwise.
The chord C[7] is played with an open string.
His reply [sic] was printed in the evening paper.
The variable %PATH% lists the folders that the shell searches.
The tag <b> makes words bold and <i> makes them slanted.
A row of dots stands where the censor cut the letter: . . . . . and the reader must guess.
The recipe says: add salt here, and stir until the foam is gone.
Type O blood was in short supply that summer.
Title and author are printed on the spine; the year is inside.
The site was chosen for its view of the bay and for its clean water.
The new station opened without ceremony at six in the morning.
Visitors who want to see the tower should ask the owner of the shop next door.
The old browser of the goat herd, a doe called Nanny, ate the lower leaves.
A reader reported that the link between the two families goes back to 1720.
The administrator of the estate sold the forest and kept the lake.
You need strong boots and a map to reach the hut; the path is not marked.
Your request for a seat on the morning boat must reach us a week before.
The user of a sextant must know the time to the second.
The content of the chest was listed by the clerk: nine coins, a ring and a key.
Tickets are no longer available at the gate; buy them at the bakery.
The internal walls of the fort were removed when the railway came.
Security at the vault failed on a Friday, and the gold was gone by Monday.
Enable the pump, open the valve and wait until the gauge shows two bars.
The requested loan was refused, and the mill changed hands in spring.
This account of the voyage was written by the ship's cook.
Session three of the congress deals with rivers and their names.
The browser of the meadow, a young deer, was seen again near the fence this week.
Our server of thirty years, Mr Alder, retires from the dining room in June.
The author deleted a chapter and replaced it with a map of the bay.
A connection between the two lakes was dug by hand in 1840.
The gate was blocked by ice, so the mail came a day late.
Access to the tower is by a stair of ninety steps.
Cookies and tea are served in the garden from three o'clock.
The page was bound into the volume upside down.
The committee found no error in the accounts of the mill.
The requested repairs were finished before the feast.
The link in the chain broke, and the anchor was lost off the point.
In this chapter we describe how a parser recovers from a syntax error without stopping.
The log shows a timeout every night at two, when the backup starts.
A request that is denied twice goes to the council.
The host welcomed his guests in the old hall.
The text of the treaty was read aloud in both languages.
The paragraph on taxes was the longest of the speech.
If the file is missing, the tool prints a message and goes on with the next one.
Missing: one grey cat, last seen on the quay on Monday.
Forbidden fruit, says the proverb, tastes best.
The exception proves the rule, or so the teacher told us.
The main road is closed from the church to the bridge, and buses run by the canal.
Maintenance of the clock takes a morning, twice a year.
A sample of the water was sent to the city for tests.
The test pilot wrote a short note about the broken wing.
Der Server im Gasthaus heißt Max und kennt jeden Gast beim Namen.
Die Verbindung nach Süden fällt am Sonntag aus.
La connexion entre les deux vallées passe par un col.
La página del diario habla de una tormenta y de un faro.
В старом доступе к башне сто ступеней.
请求被送到市长那里，三天后才有回答。
リクエストの多い曲は祭りの夜に演奏されます。
To enable the alarm, hold the red button for two seconds.
Loading and unloading is allowed until nine.
Please contact the warden if you find a lost dog.
The user guide of the loom has forty pages.
Service at the counter ends at noon.
The internal clock of the bird tells it when to leave.
Unable to sleep, the captain walked the deck until dawn.
The content of salt in the lake is low.
The library of the abbey lost its roof in the storm and was closed for a year.
The bakery is temporarily out of rye, but wheat loaves are ready at six.
Requests for seeds must be sent to the garden by post.
A loading bay was added behind the theatre in 1958.
The script calls for rain, so the crew brought hoses.
Cookies made with honey keep longer than those made with sugar.
The sailor's account of the error in the chart was not believed.
Visitors are denied nothing but a seat by the window.
The page turned, and so did the luck of the house.
Our engine retries a failed request three times and then writes it to a file.
The chapter on exceptions tells when to raise one and when to return a value.
The site of the old market is a park today.
Support for the bridge came from three towns and a duke.
The connection to the coast was missed by two minutes.
A default on the loan closed the tannery.
Access to clean water was the first demand of the strike.
The sample text in the primer was a fable about a fox.
Die Anfrage des Bürgers wurde im Rat mit einem Lachen beantwortet.
Le site de la fouille est fermé pendant l'hiver.
El archivo de la ciudad guarda cartas de tres reyes.
Запрос мельника пролежал в суде два года.
这家餐厅因为维修厨房关门一周。
駅前の工事が終わり、新しい広場が開きました。
The service in the chapel was short, and the choir sang twice.
To view the comet, look north an hour after sunset.
Missing pages were copied by hand from the other volume.
No signal was found at the mast, so they lit a fire.
The user of this path should know that the ford is deep in spring.
The manual lists each error code with its cause and its cure.
The display in the window shows clocks from four centuries.""".split("\n")

LAST_MESSAGES = """The server is currently unable to handle the request.
We were unable to load this page. Check your connection.
Sorry! Something's not right. Please reload.
The requested address has not been found.
Page unavailable. It may have been deleted by the owner.
Access forbidden! You don't have the permission to access the requested object.
Could not connect to the database server.
Error 1015: You are being rate limited.
This webpage has a redirect loop.
Service is down. We are working on it.
The gateway did not receive a timely response from the upstream server.
You don't have JavaScript enabled. This tool uses JavaScript and much of it will not work correctly without it.
JavaScript appears to be disabled in your browser.
For the best experience on our site, be sure to turn on JavaScript in your browser.
This page cannot be displayed without scripts.
Your cookies are disabled. Enable them to log in.
Exception in thread "main": array index out of bounds
Fatal: out of memory
Call to undefined function in template
Invalid API key or expired token.
Your trial has expired. Renew your subscription.
The uploaded file exceeds the allowed size.
This article is no longer available on our website.
Nothing found. Try another search.
Maintenance mode is on. Come back later.
System temporarily offline for upgrades.
We noticed unusual activity from your network. Complete the captcha to continue.
Forbidden by administrative rules.
Session expired, please login again.
Lorem ipsum is dummy content for this template.
Add your own headline and text here later.
Demo page. The content will be replaced.
Insert a paragraph about your business.
Xxxx xxxx xxxxx xxx xxxx.
Der Inhalt dieser Seite wurde entfernt.
Interner Fehler. Bitte laden Sie die Seite neu.
Bitte Cookies und JavaScript zulassen.
Page introuvable. Retournez à l'accueil.
Le contenu a été supprimé par son auteur.
Servicio temporalmente no disponible.
La sesión ha expirado. Vuelva a iniciar sesión.
Внутренняя ошибка сервера.
Файл не найден или был удалён.
网页无法显示，请检查网络连接。
このコンテンツは現在利用できません。""".split("\n")

LAST_SLOTS = """Dear [CLIENT NAME], thanks for calling.
Hi {{ contact.firstname }}!
[Your address here]
Insert text here
{company_name} was founded in {year}.
TBD - price list
<%= title %>
Ship to: %CITY%""".split("\n")

LAST_CONTENT = """The lock on the canal failed in the frost, and barges waited for nine days.
The owner of the mill deleted his name from the deed.
A disabled ship was towed into the bay at dawn.
The expired permit cost the fisherman his boat.
Her application for the post of organist was refused twice.
The memory of the flood is kept in a song.
He lost the key to the archive and broke a window.
An invalid argument is one whose premises do not support what it claims.
Our API returns an error object with a code and a message for every failed call.
The host name of each machine is painted on its case.
The user may choose between two brushes and a knife.
The search for the missing climbers was called off on Friday.
Die Suche nach dem verlorenen Ring dauerte drei Tage.
Le fichier des abonnés compte douze mille noms.
El servidor de la mesa trajo pan y aceite.
Файл из слоновой кости лежал в ящике стола.
会议因为大雪推迟到星期三。
会議は雪のため水曜日に延びました。
The bank froze the account of the duke in 1893.
Nothing was found in the cellar except old bottles.""".split("\n")
