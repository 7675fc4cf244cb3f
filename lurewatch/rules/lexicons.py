"""Lure lexicons: bank name -> phrases. One bank compiles to one case-insensitive alternation.

The banks here are the default parameter value. Each phrase states a move of the lure: who acts, on what, and to what end
(a missed delivery, a fee before a job, an account about to close). Bare nouns that ordinary mail shares, such as
package, parcel, registration fee or contribution, do not count alone. Any other table of (lexicon, pattern) rows can be
passed instead (`load_banks`), and every count, rate, span, floor and vote follows it. Patterns use no look-around and
only ASCII classes, so Java's and RE2's engines read them alike. Within a bank the leftmost match wins and matches do
not overlap.
"""

from __future__ import annotations

import re
from functools import lru_cache

_SOON = "(?:today|tonight|this (?:morning|afternoon|evening)|before (?:noon|midnight|close of business)|by (?:noon|end of day))"
_SECRET = "(?:login|log-?in|sign-?in|pass(?:word|code|phrase)|user ?name|credentials?|security (?:code|question))"
_HOLDING = "(?:account|mailbox|inbox|profile|wallet|card|subscription|membership)"
_PARCEL = "(?:package|parcel|shipment|delivery|letter|item)"
_COIN = "(?:bitcoins?|btc|ether(?:eum)?|usdt|tether|monero|litecoin)"

BANKS: dict[str, tuple[str, ...]] = {
    "urgency": (
        "urgent(?:ly)?", "without (?:any )?(?:further )?delay", "(?:needs?|must|has to) (?:be )?(?:done|paid|sent|settled|sorted) " + _SOON,
        "(?:reply|respond|answer|confirm|act) (?:" + _SOON + "|at once|straight away|now)",
        "(?:within|in) (?:the next )?(?:[0-9]{1,2}|a few|two|three|twelve|twenty[- ]four) (?:hours?|minutes)",
        "(?:last|only one) (?:chance|reminder)", "(?:deadline|offer|access) (?:ends|expires|runs out) (?:" + _SOON + "|soon|shortly)",
        "there is (?:very )?little time", "time is running out",
    ),
    "authority": (
        "(?:the|our|your|as|acting) (?:ceo|cfo|chief (?:executive|financial|operating) officer|managing director|chair(?:man|woman)?)",
        "(?:on|at) the (?:orders?|request|instruction) of (?:the|our|your) (?:director|board|chief|president|partners?|management)",
        "(?:board|executive committee) (?:has )?(?:decided|approved|asked|instructed)",
        "(?:from|by|at|with) (?:the |our |your )?(?:legal|compliance|payroll|finance|accounts|audit|hr|it|security) (?:team|desk|office|department|unit)",
        "(?:chief|head|director) of (?:finance|staff|security|people|operations|information)",
    ),
    "credential_request": (
        "(?:verify|re-?confirm|confirm|authenticate|re-?validate) (?:your|the) (?:[a-z]+ )?(?:" + _HOLDING + "|identity|e-?mail|" + _SECRET + ")",
        "(?:enter|type|provide|submit|reply with|send us|tell us) (?:in )?your (?:[a-z]+ )?" + _SECRET,
        "(?:re-?activate|unlock|unblock|recover|restore|regain access to) your " + _HOLDING,
        "your " + _SECRET + " (?:is|are|has|have|will|must|should) (?:be |been |about to |soon )?(?:expir|reset|chang|replac|lapse)[a-z]*",
        "(?:log|sign) ?in (?:here|below|through|via|using) (?:the|this|our)? ?(?:link|button|page|portal|form)?",
        "(?:strange|suspicious|unknown|unrecogni[sz]ed) (?:log-?in|sign-?in|access|session)",
        "(?:open|use|follow|press|tap) (?:the|this|our) (?:secure |safe )?(?:link|button|portal|page|form) (?:below )?(?:to|and) (?:keep|verify|confirm|prove|unlock|log|sign)",
        "(?:text|send|forward|read) (?:me|us) the (?:[0-9a-z]+[- ])?code",
    ),
    "payment": (
        "(?:make|send|start|arrange|approve|release|process|set up) (?:a|an|the|this) (?:[a-z]+ )?(?:wire|bank transfer|payment|payout)",
        "(?:wire|bank) transfers?", "(?:settle|clear|pay) (?:the|an|your|our|this) (?:[a-z]+ )?(?:invoice|bill|balance|statement)",
        "(?:new|updated|other|different|changed|following) (?:bank|account|payment|remittance|beneficiary) (?:account|details?|instructions?|information)",
        "(?:bank|account|payment) details (?:have|has) (?:been )?(?:changed|updated|replaced)",
        "(?:buy|purchase|pick up|get|scratch) (?:me |us |some |a few |several |[0-9]+ )*(?:[a-z]+ )?(?:gift|itunes|steam|prepaid) ?cards?",
        "(?:iban|swift|routing|sort code|account number)(?: code| number)?(?: is|:| below)",
        "(?:salary|payroll|direct deposit) (?:into|to) (?:a|my|another) (?:new |different )?account",
        "(?:invoice|bill|balance|amount) (?:is|was|of [^ ]+ is) (?:now )?(?:due|overdue|unpaid|outstanding)",
    ),
    "money_request": (
        "(?:send|lend|loan|give|advance|wire) (?:me|us|him|her|them) (?:[a-z]+ ){0,2}(?:money|cash|funds?|[$0-9][0-9,.]*)",
        "(?:help|assist|support) (?:me|us|them) (?:out )?(?:with|financially|by paying|by sending)(?: (?:some |a little )?(?:money|cash|funds?))?",
        "(?:short of|run out of|stranded without|no longer have) (?:any )?(?:money|cash|funds)",
        "(?:could|would|can) you (?:please |kindly )?(?:cover|pay|lend|advance|front) (?:the|my|our|this|me)",
        "i (?:will|shall|can) (?:pay|give) (?:you|it) back", "(?:pay|cover) (?:a|the|this) (?:small )?(?:[a-z]+ )?(?:fee|charge|deposit) (?:first|up front|in advance|before)",
    ),
    "identity_claim": (
        "(?:my name is|this is|i am|i'm) (?:mr|mrs|ms|miss|dr|barrister|attorney|engineer|sergeant|general)",
        "i (?:am|work as|serve as) (?:a|an|the) (?:[a-z]+ )?(?:lawyer|banker|soldier|widow|officer|diplomat|accountant|auditor|agent|founder|owner)",
        "(?:writing|contacting you|acting|calling) (?:to you )?(?:on behalf of|for) (?:the|my|our|a)", "you (?:do not|don't|may not) know me",
        "(?:we|you and i) (?:have )?(?:met|never met|spoke) (?:before|once|at|online)",
    ),
    "secrecy": (
        "(?:strictly|highly|absolutely) (?:confidential|private|secret)", "(?:keep|hold|treat) (?:this|it|the matter) (?:strictly )?(?:between|private|quiet|secret|to yourself|as confidential)",
        "(?:do not|don't|never) (?:mention|share|repeat|tell|forward|show) (?:this|it|a word|anyone|anybody)(?: (?:to|with) (?:anyone|anybody|colleagues|others))?",
        "nobody (?:else )?(?:must|should|may) (?:know|hear|learn)", "(?:only you and i|just the two of us)",
    ),
    "threat": (
        "(?:your|this|the) " + _HOLDING + " (?:is|was|has been|will be|may be) (?:permanently |temporarily )?(?:suspended|blocked|frozen|locked|limited|closed|deleted|terminated|deactivated)",
        "(?:we|they|our lawyers) (?:will|shall|may) (?:sue|prosecute|report you|take (?:you to court|legal action|further steps))",
        "(?:you|you will|or you) (?:will )?(?:face|risk|be liable for|be charged with|lose) (?:a |an |your |heavy |all )?(?:fine|fines|prosecution|arrest|penalty|penalties|access|data|files)",
        "(?:if you|should you|unless you) (?:fail|refuse|ignore|do not (?:pay|comply|respond|act|answer))",
    ),
    "reward": (
        "(?:you|your (?:email|address|number|name)) (?:have|has|were|was) (?:been )?(?:won|selected|picked|drawn|chosen) (?:as |for |the |a |to )?",
        "(?:claim|collect|receive|redeem) your (?:[a-z]+ )?(?:prize|winnings|reward|voucher|inheritance|compensation|bonus)",
        "(?:share|part|percent|half) of (?:the|his|her|this) (?:estate|fortune|inheritance|fund)", "(?:deceased|late) (?:client|customer|husband|relative)",
        "(?:[0-9.,]+|several|many) (?:million|thousand) (?:us )?(?:dollars|euros?|pounds|usd|eur|gbp)", "(?:winner|winning number) of (?:the|our|this)",
    ),
    "sextortion": (
        "(?:through|with|via|of|on) your (?:own )?(?:web)?cam(?:era)?", "(?:recorded|filmed|caught|watched) you (?:while|when|on|during|as)",
        "(?:video|clip|footage|recording|pictures) (?:of you|goes|will go|will be sent) ?(?:to (?:all |everyone )?(?:your|in your))?",
        "your (?:contacts|relatives|friends|colleagues|family) (?:will|shall|are going to) (?:see|get|receive|know)",
        "(?:infected|took over|control of|access to) your (?:device|computer|phone|screen)",
    ),
    "crypto": (
        "(?:in|by|with|of|into|to this|my|our) " + _COIN, _COIN + " (?:wallet|address|payment|transfer|account)", "(?:seed|recovery) phrase",
        "(?:connect|link|verify|migrate) (?:your|the) (?:[a-z]+ )?wallet", "0x[a-f0-9]{40}", "bc1[a-z0-9]{20,}",
    ),
    "it_support": (
        "(?:mailbox|inbox|storage|quota) (?:is|has|was) (?:almost |nearly )?(?:full|exceeded|reached|over)", "(?:over|reached|exceeded) (?:your|the) (?:mailbox |mail |storage )?(?:limit|quota)",
        "(?:held|undelivered|pending|blocked) (?:messages|mails|emails) (?:on|in|for|by)", "(?:we|it) (?:are|is|will be) (?:moving|migrating|upgrading|replacing) (?:all |the |your |our )*(?:mailbox(?:es)?|servers?|accounts?|mail)",
        "(?:keep|continue) (?:using )?(?:the |your )?(?:same|current) password",
    ),
    "attachment_lure": (
        "(?:open|see|view|check|review|download|print|sign) (?:the|this|our|my|your) (?:attached|enclosed) ?(?:file|document|invoice|form|copy|report)?",
        "(?:enable|allow|turn on|activate) (?:the )?(?:content|editing|macros?|scripts?)", "(?:scan|fax|voice ?mail|voice message) (?:is |was )?(?:attached|enclosed|received|waiting)",
        "(?:password|key|code) (?:to open|for) (?:the|this) (?:file|archive|document|zip)", "(?:document|file|message) (?:is|was) (?:encrypted|protected|locked) (?:for|by|with|and)",
    ),
    "spam_adult": (
        "(?:hot|sexy|naked|nude|horny) (?:girls?|singles?|women|wives|models?|photos?|pics?)", "(?:adult|xxx) (?:dating|chat|movies?|videos?|site)", "(?:local|lonely) (?:girls?|wives|singles) (?:want|near|waiting)",
        "(?:last|perform) (?:longer|better) in bed", "enlarge (?:your|it)",
    ),
    "spam_pharma": (
        "(?:order|buy|get) (?:your )?(?:meds|pills|medications?|tablets|drugs) (?:online|without|from|cheap)", "(?:no|without(?: a)?) (?:doctor|prescription) (?:visit |is )?(?:needed|required|necessary)?",
        "(?:lose|drop|burn|shed) (?:[0-9]+ |up to |ten |twenty )*(?:pounds|kilos|lbs|kg|weight|fat) (?:fast|in|without)", "(?:miracle|secret|ancient) (?:cure|remedy|pill|diet)",
    ),
    "spam_finance": (
        "(?:stock|share|ticker) (?:alert|pick|tip) (?:of|for)", "(?:buy|load up on) (?:shares|stock) (?:before|now)", "(?:wipe out|cut|consolidate|erase) your (?:debts?|loans?|bills)",
        "(?:lower|reduce|fix) your (?:mortgage|interest|monthly) (?:rate|payments?)", "(?:loan|credit|cash) (?:approved|granted|available) (?:in|within|even with|without|regardless)", "(?:bad|poor|no) credit (?:is )?(?:ok|no problem|welcome|accepted)",
        "(?:free spins|play poker|bet now|casino bonus)",
    ),
    "spam_commercial": (
        "(?:luxury|designer|brand[- ]name) (?:watches|bags|shoes) (?:at|for|from)", "(?:copies|imitations) of (?:luxury|famous|swiss) (?:watches|brands)", "(?:diploma|degree) (?:without|in weeks|from home)",
        "(?:reach|mail) (?:[0-9,.]+|millions of|thousands of) (?:customers|prospects|addresses|inboxes)", "(?:earn|make) (?:[$0-9][0-9,.]*|money|cash) (?:a|per|every|each|from|while) (?:day|week|month|home|you sleep)",
        "(?:up to )?[0-9]{2} ?(?:%|percent) (?:off|discount) (?:on|all|every|today)",
    ),
    "spam_bulk_marker": (
        "unsubscribe", "(?:leave|be taken off|come off|stop getting) (?:this|our|the) (?:list|mailing|mails|messages)", "(?:you|we) (?:get|got|receive|received|send|sent)(?: you)? this (?:news|news ?letter|mail|e-?mail|message) (?:because|since|as)",
        "(?:change|manage) your (?:mail|email|subscription|newsletter) (?:settings|preferences|choices)", "(?:view|read) (?:this|it) in (?:your|a) browser", "mailing list",
    ),
    "job_scam": (
        "(?:no|without) (?:prior |previous |work )?(?:experience|interview|skills) (?:is |are )?(?:needed|required|necessary|asked)",
        "(?:work|earn|job|position) (?:[a-z]+ )?from (?:home|your phone|anywhere) (?:for |and |[a-z]+ )*(?:[a-z0-9]+ )?(?:hours?|minutes) (?:a|per|each|every) day",
        "(?:[1-4]|one|two|three) hours? (?:a|per|each) day", "(?:hired|selected|shortlisted|accepted) (?:for (?:the|this|a) (?:job|post|position|role) )?(?:but|once|after) (?:you )?(?:pay|paying|payment)",
        "(?:refundable|joining|registration|training|starter|equipment) (?:fee|deposit|kit) (?:for|before|to start|to begin|secures?) (?:the|your|this|a|you)? ?(?:job|post|position|employment|work|contract|role)",
        "(?:message|write|text|add|contact) (?:me|us|our manager|the recruiter) (?:on|via|over|through) (?:whats ?app|telegram|signal)", "whats ?app me",
        "(?:like|rate|review) (?:videos|hotels|products|apps) (?:and|to|for) (?:earn|get paid|cash|money)",
    ),
    "investment_scam": (
        "(?:guaranteed|fixed|certain|assured) (?:[a-z]+ )?(?:returns?|profits?|gains?|yield)", "(?:double|triple|multiply) (?:your|any|the) (?:money|deposit|stake|savings|coins)",
        "(?:invest|deposit|start with) (?:only|just|as little as|from) [$0-9][0-9,.]*", "(?:no|zero|without) risk (?:of loss|investment|trading|to your)", "(?:trading|mining|arbitrage) (?:bot|robot|platform|group) (?:that|which|pays|with|for)",
        "(?:daily|weekly|monthly) (?:returns?|payouts?|profits?) of",
    ),
    "tech_support_scam": (
        "(?:your|this) (?:computer|pc|device|phone|system|windows) (?:is|was|has been|may be) (?:infected|hacked|at risk|compromised|blocked)", "(?:virus|trojan|spyware|malware|threats?) (?:was|were|has been|have been) (?:found|detected|discovered)",
        "(?:antivirus|protection|licen[cs]e|security plan) (?:has )?(?:expired|lapsed|run out|been renewed|was renewed|renews)", "(?:call|phone|ring|dial) (?:our|the|a) (?:[a-z]+ )?(?:support|technician|engineer|help ?line|billing|refund)",
        "(?:let|allow|give) (?:us|our technician|an engineer) (?:to )?(?:connect|remote|access|control)", "(?:to )?(?:cancel|dispute|refund) (?:this|the|your) (?:order|charge|renewal|subscription)",
    ),
    "delivery_scam": (
        "(?:could not|couldn't|unable to|were not able to|failed to|cannot) (?:be )?deliver(?:ed)? (?:your|the|a|this) (?:[a-z]+ )?" + _PARCEL,
        "(?:your|the|a) (?:[a-z]+ )?" + _PARCEL + " (?:is|was|has been|remains) (?:being )?(?:held|stopped|on hold|waiting|returned|stuck|detained|suspended|undeliverable)",
        "(?:pay|settle|cover|owe|outstanding) (?:a|an|the|for)? ?(?:small )?(?:customs|shipping|redelivery|import|postage|handling) (?:fee|charge|duty|cost|tax)",
        "(?:missed|failed|second|last|final) (?:delivery )?attempt to deliver", "(?:re-?schedule|re-?arrange|book) (?:your|the|a) (?:re)?delivery", "(?:wrong|incomplete|missing|incorrect) (?:delivery |shipping |street )?address (?:for|on) (?:your|the) " + _PARCEL,
    ),
    "govt_impersonation": (
        "(?:you are|you're) (?:due|owed|entitled to|eligible for) (?:a|an) (?:tax |government |council )?(?:refund|rebate|grant|benefit|payment)", "(?:tax|revenue|customs|immigration|social security) (?:office|authority|service|administration|agency) (?:has|have|requires|will|needs)",
        "(?:warrant|summons|complaint|case) (?:is|was|has been|will be) (?:issued|filed|opened|registered) (?:against|in|under)", "your (?:social security|national insurance|passport|tax) (?:number|record|file) (?:is|was|has been) (?:suspended|misused|blocked|flagged)", "unpaid (?:tax|taxes|fine|toll|duty)",
    ),
    "charity_fraud": (
        "(?:donate|give|contribute|transfer) (?:now|today|any amount|generously|what you can) (?:to|for|and|so)", "(?:your|every|any) (?:gift|donation|contribution|pound|dollar|euro) (?:will |can |could )?(?:feeds?|saves?|shelters?|rescues?|reach(?:es)?|buys?|provides?)",
        "(?:children|families|orphans|victims|survivors|refugees) (?:who |are |have |left )*(?:lost|without|starving|homeless|displaced|in desperate|dying|urgently need)",
        "(?:relief|emergency|disaster|flood|earthquake) (?:fund|appeal|collection) (?:for|needs|is|wallet|account)", "(?:god|heaven|the almighty) (?:will )?(?:bless|reward) (?:you|your)",
    ),
    "romance": (
        "(?:my|hello|dear) (?:darling|dearest|sweetheart|beloved|love)", "(?:fell|falling|fallen) in love (?:with you|with your)", "(?:saw|found|liked|read) your (?:profile|photo|picture) (?:and|on|in)",
        "(?:honest|loving|faithful|caring|god[- ]fearing) (?:man|woman|partner|husband|wife) (?:to|who|for)", "(?:spend|share) (?:the rest of )?(?:my|our) (?:life|lives) (?:with you|together)",
    ),
    "impersonated_brand": (
        "paypal", "microsoft", "docusign", "dropbox", "amazon", "netflix", "linkedin", "hsbc", "dhl", "fedex", "(?:apple|google|office) (?:id|account|drive|docs|pay|365)",
    ),
}
BANK_NAMES = tuple(BANKS)

# Banks whose spans a reader can point at in an exercise.
TELL_BANKS = (
    "urgency", "authority", "credential_request", "payment", "money_request", "secrecy", "threat", "reward",
    "sextortion", "crypto", "it_support", "attachment_lure",
)

# Bank -> tactic an answer about it is credited to.
BANK_TACTIC = {
    "urgency": "urgency", "threat": "urgency", "authority": "authority", "identity_claim": "authority",
    "impersonated_brand": "sender_identity", "govt_impersonation": "authority", "credential_request": "credentials",
    "it_support": "credentials", "payment": "payment", "money_request": "payment", "crypto": "payment",
    "reward": "pretext", "secrecy": "pretext", "romance": "pretext", "charity_fraud": "pretext",
    "investment_scam": "pretext", "sextortion": "pretext", "job_scam": "reply_channel",
    "attachment_lure": "attachments", "delivery_scam": "pretext", "tech_support_scam": "reply_channel",
}


def compile_bank(patterns) -> str:
    """One alternation per bank, whole words only."""
    return r"(?i)\b(?:" + "|".join(patterns) + r")\b"


def compile_banks(banks=None) -> dict[str, str]:
    return {name: compile_bank(pats) for name, pats in (banks or BANKS).items()}


#: Words so common in any text that they are poor seeds.
_COMMON = frozenset("the your you this that our and for are was has have will with from not been may must should who can".split())


def _worth(literal: str) -> int:
    """Length of a literal as a seed; nothing for a lone common word."""
    return 0 if literal.strip() in _COMMON else len(literal.strip())


@lru_cache(4096)
def seeds(pattern: str) -> tuple[str, ...] | None:
    """Lower-case literals of which every match of the pattern contains at least one, or None when there is no such set.

    Read off the standard library's own regex parse. A text without any seed cannot match, so the regex is skipped.
    """
    parser = re._parser  # noqa: SLF001

    def walk(items):
        best, run = None, ""

        def offer(found):
            nonlocal best
            if found and (best is None or min(map(_worth, found)) > min(map(_worth, best))):
                best = found

        for op, arg in items:
            if op is parser.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            offer({run} if run else None)
            run = ""
            if op is parser.SUBPATTERN:
                offer(walk(arg[-1]))
            elif op is parser.BRANCH:
                parts = [walk(b) for b in arg[1]]
                offer(set().union(*parts) if all(parts) else None)
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] >= 1:
                offer(walk(arg[2]))
        offer({run} if run else None)
        return best

    found = walk(parser.parse(pattern))
    return tuple(sorted(found)) if found and min(map(len, found)) >= 2 else None


@lru_cache(4096)
def word_seeds(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """(begin, inside): lower-case literals of which every match of the pattern contains at least one, or None when there is
    no such set. A literal of `begin` stands where a word begins, so it is looked for at word starts only; one of `inside`
    may stand anywhere.

    Read off the regex parse like `seeds`; a literal begins a word after a boundary test, a space or another sign.
    """
    parser = re._parser  # noqa: SLF001

    def worth(v):
        return _worth(v[0]) - (0 if v[1] else 2)

    def walk(items, edge):
        """The best set of a sequence, and whether a word character after it would begin a word."""
        best, run, run_edge = None, "", False

        def offer(found):
            nonlocal best
            if found and (best is None or min(map(worth, found)) > min(map(worth, best))):
                best = found

        def offer_run():
            nonlocal run
            at = next((i for i, c in enumerate(run) if not _in_word(c)), len(run))
            if run and run_edge and at:
                offer({(run, True)})
            elif run:
                offer({(run, False)})
                later = run[at:]
                offer({(later[next(i for i, c in enumerate(later) if _in_word(c)):], True)} if any(map(_in_word, later)) else None)
            run = ""

        for op, arg in items:
            if op is parser.LITERAL and arg < 128:
                if not run:
                    run_edge = edge
                run += chr(arg).lower()
                edge = not _in_word(chr(arg))
                continue
            offer_run()
            if op is parser.AT:
                edge = edge or arg is parser.AT_BOUNDARY
            elif op is parser.SUBPATTERN:
                found, edge = walk(arg[-1], edge)
                offer(found)
            elif op is parser.BRANCH:
                parts = [walk(b, edge) for b in arg[1]]
                offer(set().union(*(f for f, _ in parts)) if all(f for f, _ in parts) else None)
                edge = all(e for _, e in parts)
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
                if arg[0] >= 1:
                    offer(walk(arg[2], edge)[0])
                edge = walk(arg[2], False)[1] and (edge or arg[0] >= 1)
            elif op is parser.IN:
                edge = all(a == (parser.CATEGORY, parser.CATEGORY_SPACE) or (a[0] is parser.LITERAL and a[1] < 128 and not _in_word(chr(a[1]))) for a in arg)
            elif op not in (parser.ASSERT, parser.ASSERT_NOT):
                edge = False
        offer_run()
        return best, edge

    found, _ = walk(parser.parse(pattern), False)
    if not found or min(len(v) for v, _ in found) < 2:
        return None
    return tuple(sorted(v for v, b in found if b)), tuple(sorted(v for v, b in found if not b))


@lru_cache(4096)
def first_chars(pattern: str) -> str | None:
    """Lower-case ASCII characters of which every match begins with one (in either case), or None when that is not told.

    Read off the regex parse like `seeds`; what is no literal, plain class, group, branch or repeat tells nothing.
    """
    parser = re._parser  # noqa: SLF001

    def walk(items):
        """First characters of a sequence, and whether it may match nothing."""
        out: set[str] = set()
        for op, arg in items:
            empty = False
            if op is parser.AT:
                continue
            if op is parser.LITERAL:
                found = {arg}
            elif op is parser.IN and all(a is parser.LITERAL or a is parser.RANGE for a, _ in arg):
                found = {c for a, v in arg for c in ((v,) if a is parser.LITERAL else range(v[0], min(v[1], 128) + 1))}
            elif op is parser.SUBPATTERN:
                found, empty = walk(arg[-1])
            elif op is parser.BRANCH:
                parts = [walk(b) for b in arg[1]]
                found = None if any(f is None for f, _ in parts) else set().union(*(f for f, _ in parts))
                empty = any(e for _, e in parts)
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
                found, empty = walk(arg[2])
                empty = empty or arg[0] == 0
            else:
                found = None
            if found is None or max(found, default=0) > 127:
                return None, False
            out |= found
            if not empty:
                return out, False
        return out, True

    found, empty = (None, False) if re.search(r"\(\?[a-z]*[ux]", pattern) else walk(parser.parse(pattern))
    return None if found is None or empty else "".join(sorted({chr(c).lower() for c in found}))


def at_first_chars(pattern: str) -> str:
    """The same matches, found sooner: a look-ahead test of the first character passes over most places at one glance."""
    firsts = first_chars(pattern)
    return pattern if firsts is None else "(?=[" + "".join(re.escape(c) for v in firsts for c in sorted({v, v.upper()})) + "])" + pattern


def _in_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def prefix_free(literals) -> tuple[str, ...]:
    """Literals without those that start with another one (finding the shorter covers the longer)."""
    out: list[str] = []
    for v in sorted(set(literals)):
        if not out or not v.startswith(out[-1]):
            out.append(v)
    return tuple(out)


def trie_pattern(literals) -> str:
    """One alternation over a prefix-free set, grouped by common first characters."""
    groups: dict[str, list[str]] = {}
    for v in literals:
        groups.setdefault(v[0], []).append(v[1:])
    parts = []
    for ch, tails in groups.items():
        tail = re.escape(tails[0]) if len(tails) == 1 else trie_pattern(tails)
        parts.append(re.escape(ch) + tail)
    return "(?:" + "|".join(parts) + ")" if len(parts) > 1 else parts[0]


def word_start_pattern(literals, width: int = 5) -> str:
    """Finds, as group 1, the literal of a prefix-free set at each word start; first characters are told apart in groups."""
    firsts = sorted({v[0] for v in literals})
    some = lambda chars: "[" + "".join(map(re.escape, chars)) + "]"
    groups = [firsts[i:i + width] for i in range(0, len(firsts), width)]
    parts = [f"(?={some(g)}){trie_pattern([v for v in literals if v[0] in g])}" for g in groups]
    return rf"\b(?={some(firsts)})(?=({'|'.join(parts)}))"


def load_banks(spark, path: str) -> dict[str, tuple[str, ...]]:
    """Banks from a CSV of position,lexicon,pattern rows that Spark reads, so that any store serves; ordered by position.
    A bank is a rule table: its patterns are compiled into the plan."""
    rows = spark.read.option("header", True).option("escape", '"').schema("position int, lexicon string, pattern string").csv(path).orderBy("position", "lexicon", "pattern").collect()
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row["lexicon"], []).append(row["pattern"])
    return {k: tuple(v) for k, v in out.items()}
