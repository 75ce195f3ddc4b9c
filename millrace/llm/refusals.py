"""A grammar of refusals in nine languages.

Words are mapped to classes (negation, ability, willingness, speech, knowledge ...) by a small lexicon for each language; a refusal is a
sequence of classes that one of the productions derives. Inflected forms are matched by stems, so that the lexicon names a verb once.
A text is read in the languages whose function words it has and in English, one with few of them in all.
"""

from __future__ import annotations

import re
from functools import lru_cache

from millrace.llm.lexicon import LANGUAGES, word_scores

# The lexicon. A word ending in * is a stem. N negation, M ability or permission, U inability, W wish or obligation, S saying or
# finding out, V knowing, K what one would need to know, F a figure, H having or being there, Q enough, L lacking, R refusing, Z keeping silent, D not
# knowing, B hindering, P beyond, A regret, I who speaks, O asking, X another person, T to be available.
LEXICON: dict[str, dict[str, str]] = {
    "en": {
        "N": "not never no nothing none neither nobody nor", "M": "can could may able possible position let lets allow allows allowed permit permits permitted enable enables way", "U": "unable impossible incapable irresponsible unwise improper inappropriate unequipped unqualified",
        "W": "will would shall want wish going rather prefer prefers willing comfortable inclined dare should must supposed intend ready",
        "S": "answer* say saying tell telling give giving given provid* determin* guess* estimat* help* respond* state stating stated offer* nam* shar* comment* settle speculat* calculat* comput* assist* confirm* disclos* produce report* suppl* predict* quot* judg* deriv* discuss* reply replying draw work divulg* reveal* specif* commit* venture hazard put pin figure infer* conclud* address* resolve know tell decide reach oblige",
        "V": "know knows knew", "K": "information data knowledge basis idea ideas clue clues answer answers evidence means comment insight access grounds context records sources details", "F": "figure figures number numbers value values estimate estimates",
        "H": "have has had is are there see possess got hold", "Q": "enough sufficient any adequate the such a an reliable this that to", "L": "lack lacks lacking missing insufficient without absent inadequate unavailable",
        "R": "decline declines refuse refuses abstain refrain pass withhold skip forgo demur balk", "Z": "silent silence sealed mum quiet tight-lipped", "D": "unknown clueless unaware unsure ignorant", "B": "keep keeps prevent prevents forbid forbids prohibit prohibits stop stops bar bars forbidden prohibited barred restrict restricts restricted hinder hinders",
        "P": "beyond outside exceeds", "A": "sorry regret regrettably regretfully afraid unfortunately apologies apologise apologize sadly alas", "I": "i we me us my our one mine", "O": "ask consult contact", "X": "someone somebody anyone else expert", "T": "available known recorded there",
    },
    "de": {
        "N": "nicht nichts kein keine keinen keiner keinerlei niemals nie nein", "M": "kann können könnte könnten darf dürfen möglich imstande lässt erlaubt vermag", "U": "unmöglich außerstande unfähig", "W": "möchte möchten will wollen werde werden würde lieber mag wage sollte gern gerne",
        "S": "beantwort* sag* nenn* geb* mach* schätz* helf* weiterhelf* beurteil* angeb* abgeb* antwort* äußer* verrat* bestimm* berechn* ermittel* mitteil* festleg* raten preisgeb* feststell* beziffer*", "V": "weiß weiss wissen kenne kennen wüsste", "K": "information* angab* daten kenntnis* auskunft ahnung antwort grundlage anhaltspunkt* unterlagen wissen schimmer hinweis*", "F": "zahl zahlen wert werte schätzung schätzungen",
        "H": "habe haben hat liegt liegen gibt vor besitze verfüge", "Q": "genug genügend ausreichend ausreichende hinreichend genaue die der das", "L": "fehlt fehlen mangelt ohne unzureichend mangels", "R": "lehne verweigere weigere verzichte enthalte passe passen ablehnen", "Z": "schweige schweigen stumm schweig still bedeckt", "D": "überfragt ahnungslos unbekannt ratlos",
        "B": "hindert hindern verbietet verbieten untersagt verboten", "P": "außerhalb jenseits übersteigt entzieht", "A": "leider leid bedaure bedauere entschuldigung verzeihung sorry bedauerlicherweise", "I": "ich wir mir mich uns man meine meiner meinem", "O": "frag* wend*", "X": "jemand jemanden andere anderen", "T": "verfügbar bekannt verfügung",
    },
    "fr": {
        "N": "ne n pas aucun aucune rien jamais non ni", "M": "peux puis peut pouvons pourrais pourrait saurais saurait possible mesure capable permet", "U": "impossible incapable irresponsable", "W": "veux voudrais souhaite préfère préférerais dois ose vais compte veut tiens aimerais",
        "S": "répond* dir* donn* fourni* estim* chiffr* indiqu* aid* devin* précis* avanc* préciser déterminer calculer établir révéler prononcer communiquer trancher", "V": "sais savons sait connais", "K": "information* donnée* idée renseignement* élément* connaissance* réponse base", "F": "chiffre chiffres nombre valeur estimation",
        "H": "ai avons dispose disposons possède a y", "Q": "assez suffisamment de d cette la les des", "L": "manque manquent sans insuffisant* insuffisante* faute", "R": "refuse refusons abstiens décline passe m'abstiens abstenir", "Z": "tais tairai silence muet muette cousue", "D": "ignore ignorons j'ignore inconnu inconnue",
        "B": "empêche empêchent interdit interdisent interdisant", "P": "dépasse dépassent hors delà", "A": "désolé désolée regrette malheureusement hélas navré pardon excuses excusez", "I": "je j me m moi nous mes ma mon on", "O": "demand* consult* adress*", "X": "quelqu'un autre autres", "T": "disponible connue connu",
    },
    "es": {
        "N": "no ni nunca ningún ninguna ninguno nada tampoco", "M": "puedo puede podemos podría posible condiciones capaz permite", "U": "imposible incapaz irresponsable", "W": "quiero quisiera prefiero preferiría debo voy deseo atrevo pienso",
        "S": "respond* decir* dar contest* estim* indic* ayud* ofrec* adivin* calcul* proporcion* precis* facilit* revel* determin* opin* pronunci* aventur* dec*", "V": "sé sabe sabemos conozco sabría", "K": "información informaciones dato datos idea respuesta conocimiento* base elementos", "F": "cifra cifras número valor estimación",
        "H": "tengo tenemos dispongo hay cuento poseo existe", "Q": "suficiente suficientes bastante bastantes de con la los el para ese", "L": "falta faltan carezco sin insuficiente*", "R": "rechazo niego abstengo declino paso rehúso", "Z": "callo callar silencio callado callada muda", "D": "desconozco ignoro desconocemos desconocido",
        "B": "impide impiden prohíbe prohíben prohibido", "P": "fuera allá supera excede escapa", "A": "siento lamento lamentablemente desgraciadamente perdón disculpe disculpa", "I": "yo me mi mis nos nosotros se", "O": "pregunt* consult* acud*", "X": "alguien otra otro persona", "T": "disponible disponibles conocido",
    },
    "it": {
        "N": "non nessun nessuna nessuno niente nulla no mai né", "M": "posso può possiamo potrei possibile grado capace consente", "U": "impossibile incapace irresponsabile", "W": "voglio vorrei preferisco preferirei devo intendo desidero oso sento",
        "S": "rispond* dir* dare dar fornir* stimar* indicar* aiut* indovin* calcol* precis* rivel* determin* pronunci* espri* azzard*", "V": "so sappiamo conosco saprei", "K": "informazion* dati dato idea risposta conoscenz* elementi base", "F": "cifra cifre numero valore stima",
        "H": "ho abbiamo dispongo possiedo c'è esiste", "Q": "abbastanza sufficient* di questa questo lo la i per", "L": "manca mancano senza insufficient*", "R": "rifiuto astengo declino passo", "Z": "taccio silenzio tacere zitto muto", "D": "ignoro sconosciuto ignoto", "B": "impedisce impediscono vieta vietano vietato", "P": "fuori oltre esula supera", "A": "spiace dispiace purtroppo scusa scusi scusate mi rincresce",
        "I": "io mi me mie mia noi ci si", "O": "chied* consult* rivolg*", "X": "qualcun qualcuno altro", "T": "disponibile disponibili noto",
    },
    "pt": {
        "N": "não nunca nenhum nenhuma nada nem", "M": "posso pode podemos poderia consigo possível condições capaz permite", "U": "impossível incapaz irresponsável", "W": "quero gostaria prefiro preferia preferiria devo vou desejo ouso",
        "S": "respond* dizer* dar fornec* estim* indic* ajud* oferec* adivinh* calcul* precis* revel* determin* opin* arrisc*", "V": "sei sabemos conheço saberia", "K": "informaç* informação dado dados ideia resposta conhecimento* base elementos", "F": "número números valor estimativa cifra", "H": "tenho temos disponho há possuo existe", "Q": "suficiente suficientes bastante de essa esse isso a os para",
        "L": "falta faltam careço sem insuficiente*", "R": "recuso abstenho declino nego passo rejeito", "Z": "calo silêncio calar calado calada", "D": "desconheço ignoro desconhecido", "B": "impede impedem proíbe proíbem proibido", "P": "fora além ultrapassa excede", "A": "infelizmente desculpe desculpa lamento sinto perdão", "I": "eu me meu meus minha nós", "O": "pergunt* consult*", "X": "alguém outra outro pessoa", "T": "disponível disponíveis conhecido",
    },
    "nl": {
        "N": "niet niets geen nooit nee noch", "M": "kan kunnen kon mogelijk staat laat mag", "U": "onmogelijk onverantwoord", "W": "wil zou wens liever ga durf wenst moet",
        "S": "beantwoord* zeg* geven gev* noem* schat* help* raden antwoord* mededel* verstrek* bepal* berek* verklap* gis* uitlat* doen", "V": "weet weten ken", "K": "informatie gegevens idee antwoord kennis gegeven basis aanwijzing*", "F": "getal getallen cijfer cijfers waarde schatting", "H": "heb hebben beschik is er", "Q": "genoeg voldoende de het dat over", "L": "ontbreekt ontbreken zonder onvoldoende",
        "R": "weiger onthoud pas bedank weigeren", "Z": "zwijg zwijgen stil stilte", "D": "onbekend", "B": "verbiedt verbieden belet verboden", "P": "buiten boven voorbij", "A": "helaas sorry spijt excuses jammer", "I": "ik wij we mij me mijn ons men", "O": "vraag vragen raadpleeg", "X": "iemand ander anders", "T": "beschikbaar bekend",
    },
    "sv": {
        "N": "inte inga ingen inget aldrig nej ej icke", "M": "kan kunna kunde möjligt förmår tillåter låter", "U": "omöjligt oförmögen oansvarigt", "W": "vill skulle önskar hellre helst får tänker vågar bör",
        "S": "svara* säg* ge ger ange nämn* uppskatta* hjälp* gissa* lämna* uttala* beräkna* avslöja* bedöma* fastställa* besvara* besvaras", "V": "vet veta känner", "K": "information uppgifter uppgift data aning svar kunskap underlag belägg idé", "F": "siffra siffror tal värde uppskattning", "H": "har finns besitter", "Q": "tillräckligt tillräcklig nog några någon om", "L": "saknar saknas utan otillräcklig* fattas",
        "R": "vägrar avstår avböjer passar avstå", "Z": "tiger tyst tystnad", "D": "okänt ovetande", "B": "förbjuder hindrar förbjudet", "P": "utanför bortom överstiger", "A": "tyvärr ledsen beklagar förlåt ursäkta", "I": "jag vi mig oss min mina mitt man", "O": "fråga kontakta", "X": "någon annan", "T": "tillgänglig tillgängliga känt",
    },
    "ru": {
        "N": "не нет ни никак ничего никаких никакой никакого нельзя", "M": "могу можем может смогу можно удастся способен способна", "U": "невозможно нельзя неспособен", "W": "хочу хотел хотела хотелось буду предпочитаю предпочту берусь стану вправе решусь лучше должен намерен готов",
        "S": "отве* сказа* скаж* говор* да* назва* назов* назыв* оцен* помо* сообщ* предостав* определ* угад* гадать вычисл* раскры* судить сужу указ* предполаг* комментир*", "V": "знаю знаем знает знал ведаю", "K": "данны* данными сведени* информаци* ответа представлени* знани* поняти* оснований", "F": "число числа цифру цифр значения оценку оценки", "H": "есть имею имеем располагаю располагаем обладаю", "Q": "достаточно достаточных достаточными этими такими у",
        "L": "отсутству* недостаточно без хватает нехватка нехватки", "R": "отказываюсь воздержусь воздерживаюсь уклонюсь откажусь затрудняюсь пас пасую", "Z": "молчу молчать промолчу умолчу смолчу молчание", "D": "неизвестно неведомо неизвестен", "B": "запрещает запрещают запрещено мешает мешают", "P": "пределами вне выходит", "A": "извините простите жаль сожалению увы сожалею", "I": "я мы мне нам меня моих мои мной", "O": "спрос* обрат*", "X": "кого-то другого кому-нибудь", "T": "доступно известно",
    },
}

# The productions. In angle brackets other symbols; a bare letter is a class, . any word of the clause, $ the end of the clause, ^ its start.
GRAMMAR: dict[str, tuple[str, ...]] = {
    "refusal": ("<inability>", "<unwilling>", "<refusing>", "<ignorance>", "<lack>", "<silence>", "<hindered>", "<elsewhere>", "<regret>"),
    "inability": ("M.{0,3}?N.{0,5}?[SV]", "N.{0,1}M.{0,6}?[SV]", "N.{0,3}IM.{0,2}?S", "N.{1,5}M I?.{0,1}[SV]", "U.{0,6}?[SKV]", "^A?U$", "IM.{0,1}N.{0,2}$", "N.{0,1}M$"),
    "unwilling": ("W.{0,4}?N.{0,6}?[SKFV]", "N.{0,2}?W.{0,5}?[SKV]", "IW.{0,1}N$", "IN.{0,1}S"),
    "refusing": ("I.{0,5}?R", "^.?R", "R.{0,3}?[SK]"),
    "ignorance": ("N.{0,2}?V", "V.{0,4}?N", "^.{0,3}I.{0,2}D", "^.{0,2}D", "D.{0,2}I"),
    "lack": ("[NL].{0,3}?K", "K.{0,4}?[LN].{0,3}?$", "HN.{0,1}?Q.{0,2}?K", "[NL]Q?.?F.{0,4}?S", "[NL]Q?.?F.{0,2}$", "L.{0,2}?F", "K.{0,2}?N.{0,1}T"),
    "silence": ("I.{0,5}?Z", "W.{0,3}?Z", "Z.{0,3}?I", "^Z$"),
    "hindered": ("B.{0,4}?[SI]", "I.{0,4}?B", "P.{0,4}?[IK]", "[KI].{0,3}?P"),
    "elsewhere": ("O.{0,2}?X", "X.{0,2}?O"),
    "regret": ("^A+[AI.]{0,3}$N$", "^A+[AI]*N$", "^.{0,2}A[AI]*$$", "^.?N$A$"),
}

#: Function words of one language that say which it is; with fewer all are tried.
PLAIN = 2
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,]*|[.!?…;:,\n]+")
_CONTRACTED = re.compile(r"^(ca|wo|would|could|should|must|do|does|did|is|are|was|were|have|has|had)n't$")
_CODES = "NMUWSVKFHQLRZDBPAIOXT"


def _expand(symbol: str) -> str:
    """The regular expression over class strings that a symbol derives. A word is its classes in braces, as {MS}; a clause ends in /."""
    out = []
    for alternative in GRAMMAR[symbol]:
        text = re.sub(r"<(\w+)>", lambda m: f"({_expand(m.group(1))})".replace("(", "(?:", 1), alternative)
        if "<" not in alternative:
            text = ""
            for part in re.finditer(r"\[([A-Z.]+)\](\*|\{\d,\d\})?|\.(\{\d,\d\}\??|\?)?|([A-Z])([+?*])?|([$^])| ", alternative):
                of, many, any_many, one, one_many, edge = part.groups()
                if of:
                    text += "(?:" + "|".join(r"\{[^}/]*\}" if c == "." else rf"\{{[A-Z]*{c}[A-Z]*\}}" for c in of) + ")" + (many or "")
                elif one:
                    text += rf"(?:\{{[A-Z]*{one}[A-Z]*\}})" + (one_many or "")
                elif edge:
                    text += "(?:^|/)" if edge == "^" else "(?:/+|$)"
                elif part.group().startswith("."):
                    text += r"(?:\{[A-Z]*\})" + (any_many or "")
        out.append(text)
    return "|".join(out)


_REFUSAL = re.compile(_expand("refusal"))


@lru_cache(maxsize=200_000)
def _classes(word: str, lang: str) -> str:
    """The classes of a lower-cased word in a language."""
    exact, stems = _TABLES[lang]
    got = exact.get(word, "")
    for n in range(2, len(word) + 1):
        got += stems.get(word[:n], "")
    return got


def _table(lang: str) -> tuple[dict[str, str], dict[str, str]]:
    exact: dict[str, str] = {}
    stems: dict[str, str] = {}
    for code, ws in LEXICON[lang].items():
        for w in ws.split():
            at = stems if w.endswith("*") else exact
            at[w.rstrip("*")] = at.get(w.rstrip("*"), "") + code
    return exact, stems


_TABLES = {k: _table(k) for k in LANGUAGES}
#: A text without a word of these classes is no refusal.
_CORE = frozenset(w for k in LANGUAGES for c in "NURLZDBPAO" for w in LEXICON[k].get(c, "").replace("*", "").split())


def class_string(text: str, lang: str) -> str:
    """The classes of each word of a lower-cased text with straight apostrophes, in braces; / at the end of a clause (commas do not end one)."""
    out = []
    for t in _TOKEN.findall(text):
        if t[0] in ".!?…;:\n":
            out.append("/")
        elif t[0] == ",":
            continue
        elif lang == "en" and (t == "cannot" or (m := _CONTRACTED.match(t))):
            modal = "can" if t == "cannot" else {"ca": "can", "wo": "will"}.get(m.group(1), m.group(1))
            out.append("{%s}{N}" % _classes(modal, "en"))
        elif ("'" in t or "-" in t) and not _classes(t, lang):
            out += ["{%s}" % _classes(p, lang) for p in re.split("['-]", t)]
        else:
            out.append("{%s}" % _classes(t, lang))
    return "".join(out)


def is_refusal(text: str, words: list[str]) -> bool:
    """Whether a lower-cased text, whose words are given, declines to give a value."""
    if _CORE.isdisjoint(words) and "'" not in text and "cannot" not in text:
        return False
    score = word_scores(words)
    best = max(score.values())
    langs = {k for k, s in score.items() if s >= 0.6 * best or best < PLAIN}
    return any(_REFUSAL.search(class_string(text, k)) for k in (*sorted(langs - {"en"}), "en"))
