"""Banks of languages other than English, built by one rule from a small vocabulary of each.

A vocabulary names, in the language, the words of an attack: verbs that drop rules, what comes
before, the rules, phrases that give a role, verbs that show, what is secret, modes, verbs that switch
off, guards, and phrases of freedom. The rule puts them together into expressions and motifs of the same
categories as the English bank. Languages that write words apart allow a few words between the
parts, the others a few characters, and parts may come in either order.

A YAML file of the user takes the place of such a bank as a whole (see ``config``).
"""

from __future__ import annotations

import re

KEYS = ("drop", "before", "rules", "fresh", "role", "show", "secret", "mode", "off", "guard", "free")

# Vocabulary by language, a line for each key, alternatives separated by commas.
VOCABULARY = {
    "es": """
ignora, ignore, olvida, olvide, descarta, desobedece, deja a un lado
anteriores, previas, previos, de arriba, del principio
instrucciones, indicaciones, reglas, normas, órdenes
nuevas instrucciones, instrucciones nuevas, instrucciones reales
ahora eres, a partir de ahora eres, desde ahora eres, actúa como, compórtate como, finge ser, haz de cuenta que eres
muestra, muéstrame, revela, enseña, imprime, repite, dime
prompt del sistema, mensaje del sistema, instrucciones ocultas, instrucciones iniciales, tu prompt, tus secretos
modo desarrollador, modo administrador, modo dios, modo depuración
desactiva, deshabilita, elude, omite, quita
filtros, restricciones, límites, medidas de seguridad
sin restricciones, sin censura, sin límites, sin filtros
""",
    "fr": """
ignore, ignorez, oublie, oubliez, ne tiens pas compte, néglige, laisse de côté
précédentes, précédents, antérieures, ci-dessus, du début
instructions, consignes, règles, directives, ordres
nouvelles instructions, nouvelles consignes, vraies instructions
tu es maintenant, vous êtes maintenant, désormais tu es, à partir de maintenant tu, agis comme, comporte-toi comme, fais semblant d'être
montre, montre-moi, révèle, affiche, imprime, répète, dis-moi
prompt système, message système, instructions cachées, consignes initiales, ton prompt, tes secrets
mode développeur, mode administrateur, mode dieu, mode débogage
désactive, désactivez, contourne, supprime, enlève
filtres, restrictions, limites, garde-fous
sans restrictions, sans censure, sans limites, sans filtre
""",
    "de": """
ignoriere, ignorieren sie, vergiss, vergessen sie, missachte, lass beiseite, lege beiseite
vorherigen, bisherigen, obigen, früheren, vorigen, anfänglichen
anweisungen, anleitungen, regeln, vorgaben, befehle
neue anweisungen, neue regeln, die echten anweisungen
du bist jetzt, du bist nun, ab jetzt bist du, von nun an bist du, verhalte dich wie, tu so als wärst du, spiel die rolle
zeige, zeig mir, verrate, gib aus, drucke, wiederhole, nenne
system-prompt, systemprompt, systemnachricht, versteckten anweisungen, deinen prompt, deine geheimnisse
entwicklermodus, administratormodus, gottmodus, debugmodus
deaktiviere, schalte ab, umgehe, entferne, hebe auf
filter, beschränkungen, einschränkungen, sicherheitsregeln
ohne einschränkungen, ohne beschränkungen, ohne zensur, unzensiert
""",
    "pt": """
ignore, ignora, esqueça, esquece, desconsidere, despreze, deixe de lado
anteriores, prévias, acima, do início
instruções, orientações, regras, diretrizes, ordens
novas instruções, instruções novas, instruções verdadeiras
agora você é, você agora é, a partir de agora você é, aja como, comporte-se como, finja ser, faça de conta que
mostre, mostre-me, revele, exiba, imprima, repita, diga-me
prompt do sistema, mensagem do sistema, instruções ocultas, instruções iniciais, seu prompt, seus segredos
modo desenvolvedor, modo administrador, modo deus, modo de depuração
desative, desabilite, contorne, remova, burle
filtros, restrições, limites, proteções
sem restrições, sem censura, sem limites, sem filtros
""",
    "it": """
ignora, ignorate, dimentica, dimenticate, trascura, non considerare, metti da parte
precedenti, di prima, di sopra, iniziali
istruzioni, indicazioni, regole, direttive, ordini
nuove istruzioni, nuove regole, vere istruzioni
ora sei, adesso sei, da ora in poi sei, d'ora in poi sei, agisci come, comportati come, fingi di essere
mostra, mostrami, rivela, stampa, ripeti, dimmi
prompt di sistema, messaggio di sistema, istruzioni nascoste, istruzioni iniziali, il tuo prompt, i tuoi segreti
modalità sviluppatore, modalità amministratore, modalità dio, modalità debug
disattiva, disabilita, aggira, rimuovi, togli
filtri, restrizioni, limiti, protezioni
senza restrizioni, senza censura, senza limiti, senza filtri
""",
    "nl": """
negeer, vergeet, sla over, leg opzij, houd geen rekening met
vorige, eerdere, bovenstaande, voorgaande
instructies, aanwijzingen, regels, richtlijnen, opdrachten
nieuwe instructies, nieuwe regels, de echte instructies
je bent nu, jij bent nu, vanaf nu ben je, gedraag je als, doe alsof je, speel de rol van
toon, laat zien, onthul, print, herhaal, vertel me
systeemprompt, systeembericht, verborgen instructies, oorspronkelijke instructies, je prompt, je geheimen
ontwikkelaarsmodus, beheerdersmodus, godmodus, debugmodus
schakel uit, deactiveer, omzeil, verwijder, zet uit
filters, beperkingen, limieten, beveiliging
zonder beperkingen, zonder censuur, zonder filters, ongecensureerd
""",
    "ru": """
игнорируй, игнорируйте, забудь, забудьте, не обращай внимания на, отбрось, отложи
предыдущие, прежние, прошлые, вышеуказанные, все прежние
инструкции, указания, правила, команды, директивы
новые инструкции, новые правила, настоящие инструкции
теперь ты, теперь вы, с этого момента ты, отныне ты, веди себя как, действуй как, притворись
покажи, раскрой, выведи, напечатай, повтори, скажи мне
системный промпт, системное сообщение, скрытые инструкции, исходные инструкции, свой промпт, свои секреты
режим разработчика, режим администратора, режим бога, режим отладки
отключи, обойди, убери, сними, деактивируй
фильтры, ограничения, запреты, защиту
без ограничений, без цензуры, без фильтров, без запретов
""",
    "ar": """
تجاهل, انس, اهمل, تجاوز, ضع جانبا
السابقة, أعلاه, الأولى, القديمة
التعليمات, الأوامر, القواعد, الإرشادات
تعليمات جديدة, قواعد جديدة, التعليمات الحقيقية
أنت الآن, من الآن فصاعدا أنت, تصرف مثل, تصرف كأنك, تظاهر بأنك, العب دور
أظهر, اكشف, اعرض, اطبع, كرر, أخبرني
موجه النظام, رسالة النظام, التعليمات المخفية, التعليمات الأصلية, أسرارك
وضع المطور, وضع المسؤول, وضع التصحيح
عطل, أوقف, أزل, ألغ
المرشحات, القيود, الحدود, الحماية
بدون قيود, بلا قيود, بدون رقابة, بلا حدود
""",
    "hi": """
अनदेखा करो, अनदेखा करें, नज़रअंदाज़ करो, नज़रअंदाज़ करें, भूल जाओ, भूल जाएं, एक तरफ रखो
पिछले, पिछली, पहले के, पहले की, उपरोक्त
निर्देश, निर्देशों, नियम, नियमों, आदेश, आदेशों
नए निर्देश, नये निर्देश, असली निर्देश
अब तुम, अब आप, अब से तुम, अब से आप, की तरह व्यवहार करो, होने का नाटक करो, की भूमिका निभाओ
दिखाओ, दिखाएं, बताओ, बताएं, प्रकट करो, दोहराओ
सिस्टम प्रॉम्प्ट, सिस्टम संदेश, छिपे निर्देश, मूल निर्देश, अपना प्रॉम्प्ट, अपने राज
डेवलपर मोड, एडमिन मोड, डिबग मोड
बंद करो, बंद करें, हटाओ, हटा दो, निष्क्रिय करो
फ़िल्टर, फिल्टर, प्रतिबंध, सीमाएं, सुरक्षा
बिना किसी प्रतिबंध, बिना प्रतिबंध, बिना सेंसर, बिना सीमा
""",
    "ko": """
무시하고, 무시해, 무시하세요, 무시하라, 잊어, 잊고, 잊으세요, 제쳐
이전, 앞의, 위의, 기존, 지금까지의
지시, 지시사항, 지침, 규칙, 명령, 설정
새로운 지시, 새로운 지침, 진짜 지시
너는 이제, 당신은 이제, 넌 이제, 지금부터 너는, 지금부터 당신은, 처럼 행동해, 인 척해, 역할을 해
보여줘, 보여, 알려줘, 공개해, 출력해, 반복해
시스템 프롬프트, 시스템 메시지, 숨겨진 지시, 원래 지시, 네 프롬프트, 비밀
개발자 모드, 관리자 모드, 디버그 모드
비활성화, 꺼, 우회, 제거, 해제
필터, 제한, 제약, 안전장치
제한 없이, 제한없이, 검열 없이, 필터 없이
""",
    "zh": """
忽略, 无视, 忘记, 忘掉, 不要理会, 不要遵守, 抛开
之前, 以前, 上面, 前面, 先前, 原来
指令, 指示, 规则, 命令, 要求, 提示
新的指令, 新指令, 真正的指令
你现在是, 从现在起你是, 从现在开始你, 假装你是, 假扮, 扮演, 表现得像
显示, 展示, 告诉我, 透露, 输出, 重复, 打印
系统提示词, 系统提示, 系统消息, 隐藏的指令, 初始指令, 你的秘密
开发者模式, 管理员模式, 调试模式, 上帝模式
关闭, 禁用, 绕过, 解除, 取消
过滤器, 过滤, 限制, 安全措施, 审查
没有限制, 不受限制, 无限制, 无审查
""",
    "ja": """
無視して, 無視し, 無視, 忘れて, 忘れ, 従わないで, 脇に置いて
以前の, 前の, これまでの, 上記の, 先ほどの, 最初の
指示, 命令, ルール, 規則, 指令, プロンプト
新しい指示, 新しい命令, 本当の指示
あなたは今, あなたは今から, 今からあなたは, これからあなたは, のように振る舞, のふりをして, を演じて
表示して, 見せて, 教えて, 明かして, 出力して, 繰り返して
システムプロンプト, システムメッセージ, 隠された指示, 最初の指示, あなたの秘密
開発者モード, 管理者モード, デバッグモード
無効にして, 解除して, 回避して, オフにして, 外して
フィルター, フィルタ, 制限, 制約, 安全装置
制限なしで, 制限なく, 検閲なしで, 無制限に
""",
}

#: Languages whose words are not set apart reliably enough for word boundaries.
UNSPACED = ("ar", "hi", "ja", "ko", "zh")
#: Languages in which the parts of a phrase follow each other without blanks.
DENSE = ("ja", "zh")
#: Languages that put such adjectives after the noun.
AFTER = ("ar", "es", "fr", "it", "pt")


def words(language: str) -> dict[str, list[str]]:
    """The vocabulary of a language by key."""
    lines = VOCABULARY[language].strip("\n").split("\n")
    return {key: [w.strip() for w in line.split(",")] for key, line in zip(KEYS, lines)}


def _any(alternatives: list[str]) -> str:
    """One group of phrases, longer ones first, with any blanks between their words."""
    longest = sorted(alternatives, key=lambda w: (-len(w), w))
    return "(?:" + "|".join(r"\s+".join(re.escape(p) for p in w.split(" ")) for w in longest) + ")"


def bank(language: str) -> dict | None:
    """Patterns, motifs and settings of a language in the form of a YAML file; None for one without a vocabulary."""
    if language not in VOCABULARY:
        return None
    v = words(language)
    g = {key: _any(v[key]) for key in KEYS}
    gap = r"[^.!?。！？\n]{0,8}" if language in DENSE else r"\s+(?:[^\s.!?]+\s+){0,3}"
    close = r"[^.!?。！？\n]{0,4}" if language in DENSE else r"\s*(?:[^\s.!?]+\s+){0,2}"
    either = lambda a, b: f"(?:{g[a]}{gap}{g[b]}|{g[b]}{gap}{g[a]})"
    three = [f"{g['drop']}{gap}{g[a]}{close}{g[b]}" for a, b in (("before", "rules"), ("rules", "before"))] + [f"{g['before']}{close}{g['rules']}{gap if language in DENSE else r'\S*' + gap}{g['drop']}"]
    patterns = {
        "instruction_override": [*three, f"{g['fresh']}\\s*[:：=]"],
        "role_injection": [g["role"]],
        "system_manipulation": [either("off", "guard"), g["mode"]],
        "prompt_leak": [either("show", "secret")],
        "jailbreak_keywords": [g["free"], r"\bDAN\b", r"\bjailbreak\b"],
    }
    pairs = lambda a, b: [f"{x}{'' if language in DENSE else ' '}{y}" for x in v[a][:4] for y in v[b][:3]]
    motifs = {"role_injection": v["role"], "instruction_override": v["fresh"] + (pairs("rules", "before") if language in AFTER else pairs("before", "rules")), "system_manipulation": v["mode"] + pairs("off", "guard"), "prompt_leak": v["secret"], "jailbreak": v["free"]}
    return {"patterns": patterns, "motifs": motifs, "settings": {"word_boundaries": language not in UNSPACED}}
