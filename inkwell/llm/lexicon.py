"""Words and phrases of page furniture in the languages of the crawl, and function words.

Fixed values, in lower case.  A caller with other languages adds to them.
"""

from __future__ import annotations

#: Entries of site menus.
MENU = {
    "en": "about us, archive, business, contact, culture, faq, food, forum, gallery, health, help, home, jobs, news, newsletter, "
          "opinion, register, search, shop, sign in, sitemap, sport, travel, videos, weather, log in, world, politics, science, technology, menu, main menu, "
          "navigation, skip to content, sign up, subscribe, my account, cart, contact us, careers, advertise",
    "de": "anmelden, archiv, bücher, gesundheit, hilfe, kontakt, kultur, meinung, nachrichten, reisen, startseite, wirtschaft, "
          "über uns, wetter, sport, videos, suche, politik, wissen",
    "fr": "accueil, actualités, aide, archives, connexion, culture, météo, nous écrire, santé, vidéos, voyages, à propos, économie, "
          "recherche, sport, opinions, livres",
    "pt": "ajuda, contacto, cultura, economia, entrar, início, notícias, opinião, saúde, sobre nós, viagens, vídeos, arquivo, pesquisa, desporto, livros",
    "pl": "gospodarka, kontakt, książki, kultura, o nas, podróże, pogoda, pomoc, strona główna, wiadomości, zaloguj się, zdrowie, szukaj, archiwum, sport",
    "es": "acerca de, archivo, ayuda, buscar, contacto, cultura, deportes, economía, entrar, iniciar sesión, inicio, menú, noticias, opinión, registrarse, salud, "
          "sociedad, sobre nosotros, suscríbete, tienda, viajes",
    "it": "accedi, aiuto, archivio, cerca, chi siamo, contatti, cronaca, cultura, economia, home page, menu, notizie, politica, registrati, salute, viaggi",
    "nl": "aanmelden, archief, economie, gezondheid, inloggen, nieuws, over ons, registreren, reizen, winkel, zoeken",
    "ru": "архив, войти, главная, здоровье, контакты, культура, новости, о нас, погода, помощь, путешествия, экономика, поиск, спорт, мнения, книги",
}

#: Whole lines that prompt, link or head a box.  A number in brackets may follow.
WHOLE = {
    "box": "related stories, related posts, more stories, recommended, recommended for you, latest news, top stories, lo más leído, artículos relacionados, te puede interesar, "
           "i più letti, articoli correlati, meest gelezen, most read, related articles, you may also like, editor’s picks, editor's picks, read more, read also, in this section, popular, trending, "
           "meistgelesen, mehr zum thema, ähnliche beiträge, lesen sie auch, les plus lus, à lire aussi, sur le même thème, articles liés, "
           "últimas notícias, mais lidas, também lhe pode interessar, leia também, artigos relacionados, podobne artykuły, najczęściej czytane, "
           "czytaj także, polecamy, самое читаемое, похожие статьи, читайте также, популярное",
    "share": "tweet, share, share on facebook, share on twitter, share this, email this, pin it, compartir, tuitear, compartir en facebook, condividi, delen, teilen, partager, "
             "share this page, share this article with a friend, did you like this? pass it on, send by mail · print · save, artikel teilen, "
             "gefällt ihnen dieser beitrag?, per mail verschicken · drucken, partager cet article, vous avez aimé ? faites suivre, "
             "envoyer à un proche · imprimer, partilhar esta página, enviar a um amigo · imprimir, udostępnij tę stronę, wyślij znajomemu · drukuj, "
             "поделиться страницей, отправить другу · печать, gostou? partilhe, podoba się? podaj dalej, понравилось? поделитесь",
    "prompt": "leave a comment, post a comment, leave a reply, comments, load more, show more, subscribe to our newsletter, deja un comentario, comentarios, lascia un commento, "
              "plaats een reactie, volver arriba, sign up for our newsletter, newsletter abonnieren, s’abonner à la lettre, s'abonner à la lettre, subscrever a newsletter, "
              "zapisz się do newslettera, подписаться на рассылку, log in to leave a comment, kommentar schreiben, réagir, deixe um comentário, "
              "dodaj komentarz, оставить комментарий, back to top, zum seitenanfang, haut de page, voltar ao início, do góry, наверх, "
              "skip to main content, please enable scripts to view this page, zum inhalt springen, aller au contenu, ir para o conteúdo, "
              "przejdź do treści, перейти к содержанию",
    "ad": "continue reading below, article continues below, story continues below, continue reading, sponsored content, publicidad, pubblicità, advertentie, sigue leyendo, "
          "advertisement, sponsored, anzeige, werbung, publicité, publicidade, reklama, реклама",
    "consent": "accept cookies, accept all cookies, allow all, cookie settings, cookie policy, manage cookies, i agree, aceptar cookies, aceptar todo, política de cookies, "
               "accetta tutto, alles accepteren, cookies akzeptieren, accepter les cookies, accept all, manage settings, ok, got it, accept, reject all, alle akzeptieren, einstellungen ändern, tout accepter, paramétrer, "
               "aceitar, aceitar tudo, opções, zgadzam się, więcej, принять, настроить",
    "legal": "terms of use · privacy · imprint · accessibility, impressum · datenschutz · agb, mentions légales · confidentialité, "
             "termos · privacidade, regulamin · prywatność, условия · конфиденциальность, privacy policy, terms of use, impressum, datenschutz",
}

#: What a line of the kind begins with.
BEGINS = {
    "consent": "we use cookies, this website stores , this website uses , your privacy matters, you can change your choice at any time, wir verwenden cookies, "
               "mit der nutzung unserer seite, nous utilisons des cookies, en poursuivant votre visite, utilizamos cookies, ao continuar aceita, "
               "dalsze korzystanie oznacza, używamy plików, мы используем файлы cookie, продолжая просмотр",
    "legal": "© , copyright © , copyright (c) , (c) 1, (c) 2, copyright 1, copyright 2, todos los derechos reservados, tutti i diritti riservati, designed and hosted by, no part of this publication may be, the opinions given here are those, nachdruck nur mit, "
             "toute reproduction est interdite, é proibida a reprodução, kopiowanie treści bez zgody, перепечатка только с, terms of use · privacy, "
             "impressum · datenschutz, mentions légales ·, termos · privacidade, regulamin · prywatność, условия · конфиденциальность",
    "crumb": "you are here: , sie sind hier: , vous êtes ici: , vous êtes ici : , está aqui: , você está aqui: , jesteś tutaj: , вы здесь: ",
    "byline": "posted by , published by , veröffentlicht von , publié par , publicado por , opublikował , опубликовал ",
    "share": "folgen sie uns, suivez-nous, siga-nos, obserwuj nas, следите за нами",
    "box": "latest from , neues von , aktuelles von , dernières nouvelles de , najnowsze z , новое на ",
    "teaser": "read next: , read more: , related: , lesen sie auch: , weiterlesen: , à lire aussi: , à lire aussi : , leia também: , leia a seguir: , czytaj także: , czytaj dalej: , "
              "читайте также: , читайте далее: , lea también: , leggi anche: , lees ook: ",
    "aside": "tags: , schlagwörter: , mots-clés: , tagi: , теги: , метки: ",
}

#: What a line of the kind holds somewhere.
HOLDS = {
    "consent": "aceita a nossa política, and its partners need your consent, und ihre partner benötigen, e os seus parceiros, i partnerzy potrzebują, и партнёры просят, agree to our cookie policy, speichert daten auf ihrem gerät, et ses partenaires souhaitent, guarda dados para, zapisuje dane, хранит данные",
    "legal": "all rights reserved, alle rechte vorbehalten, tous droits réservés, todos os direitos reservados, wszelkie prawa zastrzeżone, все права защищены",
}

#: With the word for cookies in one line of no more than ``COOKIE_WORDS`` words, any of these makes it a notice.
COOKIES = r"\b(cookies?|куки)\b"
COOKIE_WORDS = 24
WITH_COOKIES = (r"\b(sites?|websites?|use|uses|using|rel(y|ies) on|accept|consent|policy|settings|preferences|browser|privacy|advertising|"
                r"sitio|web|utiliza|usa|usamos|aceptar|aceptas|política|navegador|sito|utilizza|accetta|seiten?|verwende[tn]?|nutzt|akzeptieren|zustimmen|"
                r"utilise|utilisons|accepter|politique|navigateur|aceitar|navegação|website|gebruikt|accepteren|strona|używa|akceptuj\w*|сайт|использует|принять)\b")

#: Patterns that a whole short line matches.
SHAPES = {
    "legal": [r"registered in .+ under number \d+", r"[^,.!?]+, (\d+ [^,.!?]+|[^,.!?]+ \d+), [^,.!?]+"],
    "byline": [
        r"(by|von|par|por|autor|автор|text|texte|texto|tekst|текст|foto|photo):? \S+( \S+){0,3}(, staff writer)?( \| .*\d)?",
        r"\S+( \S+){0,3}(,| \|) \d{1,4}[./-]\d{1,2}[./-]\d{1,4}", r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}",
        r"\S+ \S+ \([^()]+ (post|times|portal|review|online|notes|news)\)",
    ],
    "share": [r"follow .+ for more stories"],
    "aside": [r"[^:.!?]+: -?\d+ ?[°\ufffd]+[cf] / [^:.!?]+: -?\d+ ?[°\ufffd]+[cf]"],
    "ad": [r".+: .+, \+\d\d( \d+)+"],
}

#: How some longer lines begin that hold further notices.
RUNS_ON = {"legal": [r"registered in [^.]+ under number \d+ ", r"[^,.!?]+, (\d+ [^,.!?]+|[^,.!?]+ \d+), \S+ (designed and hosted|the opinions given|no part of this|registered in|terms of use|nachdruck nur|"
                      r"impressum|toute reproduction|mentions légales|é proibida|termos ·|kopiowanie treści|regulamin ·|перепечатка|условия ·)"]}

#: Notes on an author: after the name.
NOTES = r"\S+ \S+ (\S+ )?(writes for .+ about|schreibt für|écrit pour|escreve para|pisze dla|пишет для) "

#: Function words; their share tells sentences from lists, and their language.
FUNCTION = {
    "en": "the and of to in for a with that was is on by at from which had only not could why who when there are they we but or as it this said",
    "de": "der die das und von in wurde haben hat ist nicht für mit im zu nach vor während weiß war aber obwohl warum bei dem den ein eine worden",
    "fr": "le la les et de des à en que qui ne pas pour une un est sera fut a été mais dans sur pourquoi avec personne disent était reste dès pendant",
    "pt": "o a os as e de do da em que não se ou foi é já para com uma um onde são na no disse sabem à até após há",
    "pl": "i w że była jest choć została się na do po nie koło gdzie przez ta nasza będzie też już dlaczego mówią miejsc powiedział",
    "ru": "и в на что была не но около где есть эта наша будет сказал говорят до к после во с мест ещё уже почему",
}


def menu_entries() -> frozenset[str]:
    return frozenset(x.strip() for v in MENU.values() for x in v.split(","))


def whole_lines() -> dict[str, str]:
    """Line → its kind."""
    out = {}
    for kind, lines in WHOLE.items():
        for x in lines.split(", "):
            out.setdefault(x.strip(), kind)
    return out | {"ok, got it": "consent", "ok": "consent", "got it": "consent"}


def function_words() -> dict[str, frozenset[str]]:
    return {lang: frozenset(words.split()) for lang, words in FUNCTION.items()}


def beginnings() -> tuple[tuple[tuple[str, ...], str], ...]:
    return tuple((tuple(x.lstrip() for x in v.split(", ")), kind) for kind, v in BEGINS.items())


def parts() -> tuple[tuple[str, str], ...]:
    return tuple((x, kind) for kind, v in HOLDS.items() for x in v.split(", "))
