"""Closed-class and other very common words of nine languages, and the spellings of language labels."""

from __future__ import annotations

# Frequent function words of each language, lower case.
FUNCTION_WORDS: dict[str, str] = {
    "en": "the of and to in a is that it was for on are with as at be this have from or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long very after words called just where most know i he you they me our us it's don't can't won't i'm nobody somewhat because before while through without should does shall might such both between any own same too until upon towards near rather every",
    "de": "der die das und ist nicht ein eine einen einem einer eines zu den dem des mit von auf für im in es sie er wir ich ihr uns mir dir sich auch an als wie bei oder aber aus nach um am war waren sind hat haben hatte hatten wird werden wurde kann können nur noch schon so dass daß wenn was wer wo hier da dann man mehr sehr über unter vor durch bis zum zur kein keine keiner alle alles etwa rund ungefähr wohl vielleicht sein seine ihre ihren unser würde dürften liegt lautet ergibt welche welcher welches bitte niemand ohne gegen wieder viel viele mal hier dort weil ob denn doch jetzt immer zwischen davon dazu dabei sagen soweit liegen leider",
    "fr": "le la les un une des du de et est il elle on nous vous ils elles je tu ne pas que qui quoi dont où à au aux en dans sur sous pour par avec sans ce cet cette ces son sa ses leur leurs mon ma mes notre nos votre se si plus moins très bien peut être était étaient ont avait avaient fait comme mais ou donc car ni y l d j n s c qu m entre vers chez après avant jusqu'à depuis pendant quelle quel quelles quels combien environ arrive dirais semble faut personne rien tout toute tous toutes aussi encore déjà même autre autres deux sont ai sais peux était-ce d'après puis quand avons avez c'est n'est j'ai l'on qu'il",
    "es": "el bien buen la los las un una unos unas de del y es son que en a al por para con sin se no lo le les su sus mi mis tu nos me te si sí más menos muy pero o como cuando donde qué cuál cuáles quien quién cuánto cuántos este esta estos estas ese esa eso aquel hay había habían era eran fue fueron ha han he hemos está están sería serían entre hacia desde hasta sobre según también ya nadie nada todo toda todos todas cerca otro otra dos porque aunque parece diría creo quizá quizás algo cada así aquí allí antes después mientras valor cifra unos sido estaba",
    "it": "il bene lo la i gli le un uno una di del dello della dei degli delle da dal dalla dai in nel nella nei nelle a al alla ai alle agli con su sul sulla per tra fra e ed è sono era erano che chi cui non si ci vi ne mi ti lo più meno molto ma o anche come quando dove cosa quale quali quanto quanti questo questa questi queste quello quella ho hai ha abbiamo hanno aveva avevano stato stata essere fatto già ancora nessuno niente tutto tutta tutti tutte circa vicino secondo verso dopo prima fino perché se due altro altra direi sarebbe penso forse c'è dell all nell d l un' c' suo sua suoi loro nostro poi così sempre era",
    "pt": "o a os as um uma uns umas de do da dos das e é são que em no na nos nas ao aos à às por pelo pela pelos pelas para com sem se não lhe lhes seu sua seus suas meu minha mais menos muito mas ou como quando onde qual quais quem quanto quantos este esta estes estas esse essa isso aquele havia há era eram foi foram tem têm tinha tinham está estão estava seria seriam entre até desde sobre segundo também já ninguém nada tudo todo toda todos todas perto outro outra dois duas porque embora diria creio talvez cada assim aqui ali antes depois enquanto cerca ele ela eles nós nosso ser fica anda uns num numa bem bom sim assim",
    "nl": "de goed het een en van in is dat op te zijn met voor niet aan er die om ook als maar bij of uit naar dan nog wel tot door over was waren heeft hebben had hadden wordt worden werd kan kunnen zou zouden moet zal ik je jij hij zij ze we wij ons jullie hun mijn zijn haar dit deze wat wie waar hoe welke hoeveel hier daar geen niets niemand alle alles veel meer zeer ongeveer rond misschien tussen tegen zonder onder na voor toen al hem omdat hoewel volgens komt men uit zeggen dichtbij elkaar ander andere twee omstreeks 's weer nu zo want echter gaan wilde wilden",
    "sv": "och bra att det i en som är på av för med till den har de inte om ett han hon vi jag du ni dem sin sina sitt var vara varit hade kan kunde skulle ska från så men eller när där här vad vem hur vilken vilket vilka många mycket mer än också bara ingen inget inga alla allt några något någon över under efter före vid mellan utan mot genom sedan nu då ju nog kanske ungefär omkring kring säga enligt blir blev bli vår vårt våra oss mig dig sig hans hennes deras denna detta dessa två man upp ut ner in hos medan eftersom tills åt ha sade ville fick",
    "ru": "и в во не на я он она они мы вы что с со как а то все всё но да к ко у же за бы по от из о об это этот эта эти так его её ее их только мне было был была были быть есть до для или если уже ни при когда где кто чем чего без нас вас нам вам там тут здесь какой какая какое какие сколько около примерно может можно надо тоже также ещё еще очень после перед между под над через про никто ничего себя свой сам один два значение число получается получится сказал бы судя записям выходит среднем думаю потом чтобы хотя пока потому",
}

LANGUAGES = tuple(FUNCTION_WORDS)
SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

# Names of the languages as labels spell them (ISO 639 codes of two and three letters, English and own names).
LABELS: dict[str, str] = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands flemish",
    "sv": "sv swe swedish svenska",
    "ru": "ru rus russian русский",
}
LABEL_OF = {w: k for k, v in LABELS.items() for w in v.split()}
# Codes and names of other languages, so that a label with one of them is wrong, not missing.
OTHER_CODES = frozenset("pol dan nor nob fin ces cze tur ell gre hun ron rum ukr zho chi jpn ara heb kor cat bul hrv srp slk slv est lav lit polish danish norwegian finnish czech turkish greek hungarian romanian ukrainian chinese japanese arabic hebrew korean catalan bulgarian croatian serbian slovak slovenian estonian latvian lithuanian latin ar bg bn ca cs cy da el et eu fa fi ga gl he hi hr hu id is ja ka kk ko la lt lv mk ms nb nn no pl ro sk sl sq sr sw ta th tr uk ur vi zh".split())


def label_language(label: str | None) -> str | None:
    """The language that a label names, in any spelling and with or without a region; None if it names none."""
    if not label:
        return None
    s = label.strip().lower()
    if s in LABEL_OF:
        return LABEL_OF[s]
    head = s.replace("_", "-").split("-")[0].split("(")[0].strip()
    if head in LABEL_OF:
        return LABEL_OF[head]
    return head if head in OTHER_CODES else None


#: What each function word says: the languages that have it, and the share of each.
SAYS = {w: (tuple(k for k in LANGUAGES if w in SETS[k]), 1.0 / sum(w in SETS[k] for k in LANGUAGES)) for w in frozenset().union(*SETS.values())}


def word_scores(words: list[str]) -> dict[str, float]:
    """What some lower-cased words say for each language: a function word counts the less the more languages have it, a word in Cyrillic letters counts for Russian."""
    score = dict.fromkeys(LANGUAGES, 0.0)
    for w in words:
        if "Ѐ" <= w[0] <= "ӿ":
            score["ru"] += 1.0
        elif w in SAYS:
            having, share = SAYS[w]
            for k in having:
                score[k] += share
    return score


def word_language(words: list[str]) -> tuple[str | None, float, float]:
    """(most likely language, its score, the runner-up's)."""
    best = sorted(word_scores(words).items(), key=lambda kv: -kv[1])
    return (best[0][0] if best[0][1] > 0 else None), best[0][1], best[1][1]
