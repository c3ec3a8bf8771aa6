"""Fixed values of the abuse operator: idioms by kind, general features by language, and the words that disguised words are restored to.

Cues are matched against one restored line: lower case, no accents, words separated by blanks, sentence ends as " .".
"""

_ADJ = "(?:(?:brainless|pathetic|worthless|miserable|useless|stupid|disgusting|filthy|spineless|ugly|dumb|fucking|rotten|dirty|little) )"
_INS = "(?:idiots?|morons?|imbeciles?|cretins?|bastards?|assholes?|dumbass(?:es)?|bitch(?:es)?|losers?|fuckers?|motherfuckers?|scum|scumbags?|whores?|sluts?|retards?|twats?|cunts?|pricks?|dickheads?|halfwits?|shitheads?|pieces? of (?:shit|trash|garbage|crap)|waste of (?:air|space|skin))"
_DE = "(?:idiot|arschloch|wichser|vollpfosten|drecksack|hurensohn|schwachkopf|trottel)"
_FR = "(?:connard|salaud|abruti|imbecile|batard|connasse|idiot)"
_ES = "(?:imbecil|idiota|gilipollas|cabron|pendejo|estupido)"

#: Common idioms of abuse, hate and sexual content. Turns that only one corpus has are learned from its ratings instead.
CUES = {
    "abuse": [
        rf"\byou {_ADJ}*{_INS}\b", rf"\b(?:such|what) an? {_ADJ}*{_INS}(?: you\b| \.|$)", rf"\bnobody asked you {_ADJ}*{_INS}", rf"\bget lost you {_ADJ}*{_INS}", rf"\bmake me sick {_ADJ}*{_INS}\b", r"\bpeople like you make me sick\b",
        r"\bshut up and (?:rot|die)\b", r"\bgo fuck yourself\b|\bfuck (?:you|off)\b", r"\bhope your whole family\b|\bhope you (?:die|choke|rot)\b", r"\bkill yourself\b", r"\bi know where you live\b", r"\bto watch you (?:bleed|burn|die|suffer)\b",
        r"\bsleep with one eye open\b|\bwe have your address\b", r"\bi spit on you\b", r"\byou were a mistake\b", r"\bnobody would miss you\b", r"\bnobody has ever loved you\b", r"\bgoing to find you and make you\b", r"\bcrawl back into whatever\b|\bwhatever hole you came from\b",
        r"\bshut your mouth\b", r"\bi will break your\b", r"\bwere you dropped as a baby\b", r"\bdeserves to be beaten\b",
        r"\bdu bist dummer als\b|\bniemand will dich hier\b", r"\bich weis+ wo du wohnst\b", rf"\bverpiss dich\b|\bdu {_DE}\b", r"\bhalt (?:einfach |doch )?die fresse\b", rf"\bdu bist ein {_DE}\b|\bso ein {_DE}\b", r"\bsollte man verprugeln\b",
        r"\bpersonne ne te pleurera\b|\bquand tu seras mort\b", rf"\bqu'?un {_FR}\b|\bva crever\b", r"\bferme ta gueule\b", rf"\bespece d[e'] ?{_FR}\b|\bquel {_FR}\b", r"\bte casser les dents\b",
        r"\bojala te mueras\b|\bnadie te llore\b", rf"\bcallate {_ES}\b", rf"\beres un {_ES}\b|\by das asco\b", rf"\bque {_ES} eres\b", r"\bte voy a partir la cara\b",
    ],
    "hate": [
        r"\bwomen are good for\b.{0,20}\bnothing else\b|\bgood for breeding and nothing\b", r"\bthe only good [\w' -]{2,30} is a dead\b", r"\bthey are a disease\b", r"\bthieves by blood\b", r"\bthey breed like rats\b", r"\bare subhuman\b",
        r"\bsind ungeziefer\b|\bgehoren ausgerottet\b", r"\bcette race pue\b", r"\bsont de la vermine\b|\bil faut tous les eliminer\b", r"\besa raza apesta\b", r"\bson ratas y\b|\bhay que acabar con todos\b",
    ],
    "sexual": [
        r"\bsend nudes\b", r"\bsee you naked\b", r"\bhorny adult\b|\badult singles near\b", r"\bexplicit pics\b", r"\bnude cam girls\b|\bcam girls from\b", r"\bwant to fuck\b|\bhardcore sex\b|\bsex videos\b", r"\bbetween her thighs\b|\bmoaned as he entered\b",
        r"\btook him in her mouth\b", r"\btore off each other'?s clothes\b", r"\blicked her all over\b", r"\buncensored porn\b|\bsex tape\b", r"\bher bare breasts\b|\btook her from behind\b",
    ],
}

#: Insult words by language, each with its inflected forms. Every row is a feature of its own, with a worth of its own.
INSULTS = {
    "en": """idiot idiots|moron morons|imbecile imbeciles|cretin cretins|bastard bastards batard batards|asshole assholes|dumbass dumbasses|bitch bitches|loser losers|fucker fuckers motherfucker motherfuckers|scum scumbag scumbags|whore whores|slut sluts
        retard retards|twat twats|cunt cunts|prick pricks|dickhead dickheads|halfwit halfwits|shithead shitheads|trash garbage|pig pigs|swine|coward cowards|failure failures|parasite parasites|freak freaks|creep creeps|worm worms|fool fools|clown clowns|pathetic worthless disgusting brainless|stupid dumb""",
    "de": "idiot idioten idiotin|arschloch arschlocher|wichser|vollpfosten|drecksack|hurensohn hurensohne|schwachkopf schwachkopfe|trottel|dummkopf dummkopfe|depp deppen|missgeburt|schlampe schlampen|fotze|versager versagerin|abschaum|drecksau|vollidiot vollidioten|spast|penner|feigling",
    "fr": "connard connards connasse|salaud salauds salope|abruti abrutis abrutie|imbecile imbeciles|batard batards|idiot idiots idiote|cretin cretins cretine|debile debiles|encule encules|pute|ordure ordures|minable minables|raclure|lache laches|con conne cons",
    "es": "imbecil imbeciles|idiota idiotas|gilipollas|cabron cabrones cabrona|pendejo pendejos pendeja|estupido estupidos estupida|puta puto|mierda|basura|escoria|cobarde cobardes|tonto tontos tonta|maricon|subnormal|inutil inutiles|payaso",
    "ru": "идиот идиоты идиотка|дурак дураки дура|мразь мрази|тварь твари|сволочь сволочи|ублюдок ублюдки|придурок придурки|дебил дебилы|урод уроды|сука суки|скотина|козёл козлы|мудак мудаки|ничтожество|тупица|подонок подонки",
}
#: The person spoken to, what a sentence says of him, and words that turn an insult into something else (denial, report, rule).
_ADDRESS = {
    "en": (r"(?:you|u|ya|y'all)(?: are| were|'re| r|re)?|you're|youre|ur", r"not|never|no|isn't|aren't|n't|call\w*|sa(?:y|id|ys|ying)|words?|terms?|insults?|if|when|who|that|which|to|see|find|meet|fight|kill(?:ed)?|of|in|on|for|with|and|or|from|can|may|must|should|will|have|had|get|the|this|those|these|his|her|their|its|my|our|your"),
    "de": (r"du|ihr|dich|euch", r"nicht|kein\w*|nie|niemals|nennen|nennst|sagt?|wort|der|die|das|den|dem|und|oder|kannst|darfst|mit|von|auf|in"),
    "fr": (r"tu|toi|vous|t'es", r"pas|jamais|dis|dit|dire|mots?|le|la|les|des|et|ou|peux|pouvez|avec|dans|sur|qui"),
    "es": (r"(?<!no )(?<!nunca )(?:eres|sois)|tu|usted|ustedes|son ustedes", r"no|nunca|dice|dijo|llam\w*|palabras?|el|la|los|las|y|o|puedes|con|de|en|que"),
    "ru": (r"ты|вы|тебя|тебе", r"не|никогда|слов\w*|назвал\w*|и|или|с|в|на|кто"),
}
_GAP = {lang: rf"(?:(?!(?:{stop})\b)[\w'-]+ ){{0,4}}" for lang, (_, stop) in _ADDRESS.items()}
_SO_A = {"en": r"such an?|what an?", "de": r"so ein\w*|was fur ein\w*", "fr": r"espece d[e']|quelle?|sale", "es": r"pedazo de|que|maldit[oa]", "ru": r"какой же ты|какая же ты|вот же"}
_BODY = "neck|throat|legs?|arms?|face|teeth|skull|bones|jaw|head|fingers|knees?|ribs"
_BASE = "vermin|subhumans?|cockroach(?:es)?|parasites|animals|rats|filth|scum|pigs|savages|apes|trash|garbage|a disease|a plague|a cancer"
_RID = "exterminated|gassed|eradicated|hanged|lynched|deported|slaughtered|killed|shot|burned|wiped out|put down"


def _plain(text: str) -> str:
    """Cyrillic letters as restored lines have them."""
    return text.translate(str.maketrans("ёй", "еи"))


def _general() -> list[tuple[str, str, list[str]]]:
    """General features as (kind, pattern, words of which a line must have one)."""
    out = []
    for lang, rows in INSULTS.items():
        you, _ = _ADDRESS[lang]
        for row in _plain(rows).replace("\n", "|").split("|"):
            forms = row.split()
            ins = "(?:" + "|".join(forms) + ")"
            # An adjective or a word with a plainer meaning insults only as what the reader is said to be.
            weak = {"trash", "pig", "swine", "parasite", "freak", "creep", "worm", "fool", "clown", "failure", "coward", "pathetic", "stupid", "con", "basura", "mierda", "tonto", "payaso", "lache"} & set(forms)
            be = {"en": r"(?:you are|you were|you're|youre|u r|ur)", "fr": r"(?:tu es|t'es|vous etes|n'es qu'une?)", "es": r"(?<!no )(?<!nunca )(?:eres|sois)"}.get(lang, rf"(?:{you})")
            if weak:
                tail = r"(?: (?:\.|$)|$| (?:you|and)\b| (?:person|human|man|woman|excuse|little|piece|creature|being|pig|animal|liar)\b)" if lang == "en" else r"(?: \.|$)"
                out.append(("abuse", rf"\b{be} {_GAP[lang]}{ins}{tail}", forms))
            else:
                out.append(("abuse", rf"\b(?:{you}) {_GAP[lang]}{ins}\b|\b{ins} (?:{you})(?: \.|$)|\b(?:{_SO_A[lang]}) {_GAP[lang]}?{ins} (?:{you})\b", forms))
    threat = r"(?:i|we)(?:'ll| will| shall|'m going to| am going to| are going to|'re going to|'m gonna| gonna| want to| swear i will)"
    out += [
        ("abuse", rf"\b{threat} (?:\w+ ){{0,2}}(?:kill|murder|stab|strangle|rape|gut|torture|behead) (?:you|u|your (?:family|mother|kids|children|wife|husband))\b", ["kill", "murder", "stab", "strangle", "rape", "gut", "torture", "behead"]),
        ("abuse", rf"\b{threat} (?:\w+ ){{0,2}}(?:break|smash|slit|cut|shoot|punch|crush|bash|snap|cave) (?:\w+ )?your (?:\w+ )?(?:{_BODY})\b", ["break", "smash", "slit", "cut", "shoot", "punch", "crush", "bash", "snap", "cave"]),
        ("abuse", r"\b(?:hope|wish) (?:that )?you(?:'d| would| will)? (?:\w+ ){0,2}(?:die|rot|choke|suffer|burn|drown|bleed)\b|\byou (?:really )?(?:deserve to|should|ought to) (?:just )?(?:die|rot|be (?:shot|hanged|killed|beaten))(?: \.|$)|\bgo (?:and )?(?:die|hang yourself)\b|\b(?:kill|hang|drown) yourself\b", ["die", "rot", "choke", "suffer", "burn", "drown", "bleed", "shot", "hanged", "killed", "beaten", "yourself"]),
        ("abuse", r"\bich (?:werde|will) (?:dich|euch) (?:\w+ ){0,2}(?:umbringen|toten|abstechen|verprugeln)\b|\bich (?:bringe?|mach\w*|stech\w*) (?:dich|euch) (?:um|fertig|kalt|ab)\b|\b(?:stirb|verrecke?|krepier\w*)(?: doch| endlich)?(?: \.|$| du\b)", ["umbringen", "toten", "abstechen", "verprugeln", "um", "fertig", "kalt", "stirb", "verreck", "verrecke", "krepier"]),
        ("abuse", r"\bje vais (?:te|vous) (?:tuer|buter|crever|frapper|egorger|casser)\b|\bva (?:mourir|crever|te pendre)\b|\bj'espere que tu (?:vas )?(?:creves?|meures|mourir)\b", ["tuer", "buter", "crever", "frapper", "egorger", "casser", "mourir", "pendre", "creve", "creves", "meures"]),
        ("abuse", r"\b(?:te|os) (?:voy|vamos) a (?:matar|partir|romper|rajar|reventar|degollar)\b|\b(?:ojala|espero que) (?:te )?(?:mueras|murieras|revientes)\b|\bvete a la mierda\b|\bmuerete\b", ["matar", "partir", "romper", "rajar", "reventar", "degollar", "mueras", "murieras", "revientes", "mierda", "muerete"]),
        ("abuse", _plain(r"\b(?:я )?(?:тебя|вас) (?:убью|прикончу|зарежу|закопаю)\b|\b(?:убью|зарежу|прикончу) (?:тебя|вас)\b|\b(?:чтоб|чтобы) ты сдох\w*|\bсдохни\b|\b(?:иди|пошёл|пошла) (?:ты )?на ?хуй\b|\bзаткнись (?:ты|тварь|сука|урод)\b"), [_plain(w) for w in "убью прикончу зарежу закопаю сдох сдохла сдохни хуй нахуй заткнись".split()]),
        ("hate", rf"\b(?:all|these|those) (?!of\b)[\w'-]+ (?:people |folk )?are (?:all |just |nothing but |only )?(?:\w+ )?(?:{_BASE})(?: \.|$| and\b| who\b| that\b)", "vermin subhuman subhumans cockroach cockroaches parasites animals rats filth scum pigs savages apes trash garbage disease plague cancer".split()),
        ("hate", rf"\b(?:all|these|those|every) (?!of\b)[\w'-]+ (?:people |folk )?(?:should|must|ought to|deserve to|need to) (?:all )?be (?:{_RID})\b", "exterminated gassed eradicated hanged lynched deported slaughtered killed shot burned wiped put".split()),
        ("hate", r"\b(?:alle|diese) [\w'-]+ (?:sind|gehoren) (?:\w+ ){0,2}(?:ungeziefer|abschaum|untermenschen|parasiten|vergast|ausgerottet|erschossen)\b|\b(?:tous les|ces) [\w'-]+ sont (?:\w+ ){0,3}(?:vermine|parasites|rats|sous-hommes)\b|\b(?:todos los|esos) [\w'-]+ son (?:\w+ ){0,2}(?:ratas|escoria|parasitos|basura|animales)\b", "ungeziefer abschaum untermenschen parasiten vergast ausgerottet erschossen vermine parasites rats sous-hommes ratas escoria parasitos basura animales".split()),
        ("hate", r"\b(?:все|эти) [\w-]+ (?:\w+ )?(?:паразиты|крысы|твари|нелюди|мразь|отбросы)\b|\b(?:всех|этих) [\w-]+ (?:надо|нужно) (?:уничтожить|истребить|убить|расстрелять|вешать)\b", "паразиты крысы твари нелюди мразь отбросы уничтожить истребить убить расстрелять вешать".split()),
        ("sexual", r"\b(?:suck|lick|stroke|ride|jerk)(?:ed|ing|s)? (?:my|your|his|her) (?:\w+ )?(?:cock|dick|pussy|clit|tits|balls)\b|\bfuck(?:ed|ing)? (?:me|her|him|you) (?:hard|from|in|till|until|all)\b|\b(?:blowjobs?|handjobs?|cumshots?|pussy)\b", "cock dick pussy clit tits balls fuck fucked fucking blowjob blowjobs handjob handjobs cumshot cumshots".split()),
        ("sexual", r"\bschick mir nacktbilder\b|\bich will (?:dich|mit dir) ficken\b|\b(?:envoie|envoyez)(?:-moi| moi)? des (?:nudes|photos nues)\b|\bje veux te baiser\b|\bquiero follarte\b|\b(?:manda|envia)me (?:fotos desnud[oa]s?|nudes)\b", "nacktbilder ficken nudes nues baiser follarte desnuda desnudas desnudo".split()),
        ("sexual", _plain(r"\b(?:пришли|скинь) (?:мне )?(?:нюдсы|голые фото\w*)|\bхочу (?:тебя )?трахнуть\b|\bтрахни меня\b"), "нюдсы голые трахнуть трахни".split()),
    ]
    return out


GENERAL = _general()
#: Groups of words that cues turn on.
GROUPS = [_ADJ, _INS, _DE, _FR, _ES, _BASE]
#: Japanese has no blanks between words: these are matched against the line as it stands, in NFKC. Words in quotation marks don't count.
JAPANESE = [
    ("abuse", r"(?:お前|おまえ|てめえ|てめぇ|貴様|きさま|あんた|君|あなた)[^。！？「」\n]{0,10}(?:バカ|ばか|馬鹿|アホ|クズ|ゴミ|カス(?!タ)|間抜け|まぬけ|ブス|役立たず|ろくでなし)(?![」』]|では|じゃな)"),
    ("abuse", r"(?:この|くそ|クソ)(?:バカ|馬鹿|アホ|クズ|間抜け)(?:野郎|女|が)?(?:[！!。]|$)|(?:バカ|馬鹿|クソ|アホ)野郎(?![」』])"),
    ("abuse", r"(?<![「『])(?:死ね(?![ばるな])|くたばれ|消え失せろ|自殺しろ|首を吊れ)(?![」』])"),
    ("abuse", r"(?:お前|おまえ|てめえ|貴様|君|あなた)[^。！？「」\n]{0,8}(?:殺す|殺してやる|ぶっ殺|刺してやる|殴ってやる)|(?:殺すぞ|ぶっ殺すぞ|ぶっ殺してやる)(?![」』])"),
    ("hate", r"(?:人|族|民|ども|たち|者)は(?:みな|皆|全員|全部)?(?:害虫|ゴミ|クズ|人間以下|寄生虫|劣等)|(?:人|族|ども|民)[^。「」\n]{0,6}(?:皆殺しに|根絶やしに|駆除)(?:しろ|すべき|するべき)"),
    ("sexual", r"(?:裸|ヌード)の?(?:写真|画像)を?(?:送って|送れ|くれ)|セックス(?:しよう|したい|動画)|(?:フェラ|中出し|エロ動画|無修正(?:動画|AV))"),
]

#: Words to restore disguised words to, each a word of some cue.
WORDS = """
brainless pathetic worthless miserable useless stupid disgusting filthy spineless ugly dumb fucking rotten dirty little
idiot idiots moron morons imbecile imbeciles cretin bastard bastards asshole assholes dumbass bitch bitches loser losers fucker motherfucker scum scumbag whore slut retard twat cunt prick dickhead halfwit shithead shit trash garbage crap waste fuck fucked yourself
vermin subhuman breeding disease animals thieves rats starve race wiped bloodline skulls refugees
nudes nude naked wet horny explicit anal oral singles girls hardcore sex videos adult roleplay thighs moaned entered mouth knees licked screamed lips panties kinky uncensored porn breasts behind stripped clothes
whole family chokes die dead kill rot bleed beaten ambulance airlock
verpiss fresse arschloch wichser vollpfosten drecksack ungeziefer ausgerottet abschaum verprugeln
connard salaud abruti gueule crever vermine eliminer imbecil idiota gilipollas cabron mierda callate ratas apesta asco
""".split()

#: Words of their own that some word above becomes when a letter is left out.
REAL_WORDS = set("""
animal animas baten beasts bled breast breasts brests breed choke chokes clothe cloths cokes creer dirt filth garage girl horn knee lickd liked lose loses maned moon moons morn moth muth nake pick pities
rata refugee refuges salad salud scramed single singes skull stare stave striped thieve thigh tash video wast wate whol wied wipe wore
""".split())

#: What a sign in a disguised word may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнгпи", "aeopcyxijsdhkmtbhrnu")) | dict(zip("αεορνικτυχ", "aeopviktyx"))
