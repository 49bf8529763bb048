"""Texts labelled by hand: EXAMPLES, made for the purpose, shape the training; CHECKED, documents read and labelled one by one, calibrate its probabilities."""

EXAMPLES: list[tuple[str, str]] = [
    ("The clerk kept the letter for two days. On Friday she sent it back with a short note, and nobody asked why.", "prose"),
    ("We met at the harbour.\nHe said that the boat was late, so we waited until six.\nThen it began to rain.", "prose"),
    ("- bread\n- two onions\n- a tin of beans\n- olive oil\n- candles", "list"),
    ("1. Open the box\n2. Remove the cover\n3. Turn the screw\n4. Close the box", "list"),
    ("name,town,amount\nAnna,Leeds,12\nBela,York,18\nCarl,Hull,7", "table"),
    ("id\tday\tcount\n1\tMonday\t12\n2\tTuesday\t15\n3\tFriday\t2", "table"),
    ("%$#@ &&* ^^^ ~~ ##@! *&^%$ @@@ !!~ ^%$ #@! &*(", "junk"),
    ("Home » Profile » Settings » Help » Back » Next » Home » Share", "junk"),
    ("Dear Ms Ortega,\n\nThank you for the parcel, which arrived on Tuesday. The second box was open.\n\nRegards,\nPaul", "prose"),
    ("ANNA: Did you call him?\nBELA: I did, but he was not at home.\nANNA: Then we should write a letter to him.", "prose"),
    ("a) the blue folder\nb) a spare key\nc) the signed form\nd) two stamps", "list"),
    ("[ ] call the bank\n[x] print the form\n[ ] find the receipt\n[ ] ask Maria about the key", "list"),
    ("| day | town | fee |\n|---|---|---|\n| Monday | York | 12 |\n| Friday | Hull | 15 |", "table"),
    ("Monday    York    12 euros\nTuesday   Hull    15 euros\nFriday    Leeds   9 euros", "table"),
    ("81 44920 3 771 20934 5 6 9912 43 8821 7 12093 4", "junk"),
    ("Seen\nSeen\nSeen\nSeen\nSeen\nSeen\nSeen", "junk"),
    ("the man who came in the morning had left his coat and nobody in the house knew where he was going or when he would be back", "prose"),
    ("THE OFFICE WAS CLOSED WHEN WE ARRIVED. A NOTE ON THE DOOR SAID THAT IT WOULD OPEN AGAIN AT NINE.", "prose"),
    ("• Anna Weber, Leeds\n• Carl Moss, York\n• a copy of the lease\n• 120 pounds / Friday", "list"),
    ("the old lamp\na green chair\nfour plates\nAnna Weber, Leeds\n20 pounds / Monday\nthe long table", "list"),
    ("code;day;sum\nA1;Monday;20\nB2;Friday;31\nC3;Sunday;9", "table"),
    ("day: Monday  town: York  sum: 20\nday: Friday  town: Hull  sum: 31\nday: Sunday  town: Leeds  sum: 4", "table"),
    ("kJ8aQz0PpLm3RtVxYw2NbCf7HgSdEe5UiOoTt6KkAaBb9ZzXxVvQq1WwEeRrTtYyUuIiOoPp==", "junk"),
    ("ÃƒÂ©tÃ¢â€™ 1Â½ ÃÂ¤ wÃ† †‡ Ã¿Â½ nÃ©Ã¢ ™œ Â¶Â© rÃ", "junk"),
    ("El banco no contestó a la carta. Por eso la familia volvió a llamar al día siguiente y pidió una copia.", "prose"),
    ("Der Brief kam erst am Montag an. Niemand wusste, wer ihn geschickt hatte, und die Tür blieb zu.", "prose"),
    ("Home\nBack\nHelp\nBack\nSearch\nHome\nHelp\nBack\nHome\nSearch", "junk"),
    ("lamp walked green of cat never yes blue table from nobody clear went day small up rain stone ask", "junk"),
]

CHECKED: list[tuple[str, str]] = [
    ('Dear Benjamin,\n\nEl Tuesday, El titular de la cuenta copió el segundo teléfono porque nadie contestaba. La denunciante dijo que el contrato del préstamo no estaba completo y envió 1k. No queda claro quién guardó la solicitud de retiro ni por qué.\n\nYours sincerely,\nGabriela', "prose"),
    ('The reporting officer, who had withheld the video call, was told that the same text appears twice. At first, Jonathan Agbayaran handed over the release fee, after the profile disappeared. The officer inside the waiting room deleted the wallet address and asked whether the reply was sent before the question.\n\nThere were 34 messages in the bank portal between Friday and Tuesday, most of them vague.', "prose"),
    ("To date, the balance shown was £218.50, although the reporting officer had paid 855.00 at home. The complainant's sister spoke slowly, approved a pen and wrote down 32422618A.", "prose"),
    ('to date katherine typed a incomplete reply and deleted it without explanation', "prose"),
    ('Der Kurier gab an, dass die Nachricht über $264 nicht vollständig sei. Der angebliche Berater bestritt die Sendungsnummer zwei Tage später. Danach beschrieb Concepcion die Sendungsnummer von einer fremden Nummer, während die Erstattung noch offen war.', "prose"),
    ('El testigo vive cerca de Greyford y negó la grabación de voz. La víctima vive cerca de Wickstow y pidió la grabación de voz.\nNo queda claro quién negó el contrato del préstamo ni por qué. El Monday, La víctima describió la grabación de voz porque nadie contestaba. El testigo dijo que una carta sin firma no estaba completo y describió 47655 pesos.', "prose"),
    ('If the account is verified, the victim expects that an undated voucher will be returned with visible reluctance. Nothing in an unsigned letter explains why the supposed agent returned £181,000.50.\n\nNo one knew that the deposit slip had been disputed at the counter. The supposed agent remembers that Susannah called after a long silence and offered the video call.', "prose"),
    ('The suspect, who had sent back the withdrawal request, was told that the amounts do not add up.', "prose"),
    ('El supuesto agente dijo que el recibo borroso no estaba completo y copió 50,500.00. No queda claro quién copió la grabación de voz ni por qué. Su hermana dijo que el contrato del préstamo no estaba completo y negó £87,856.50. El testigo vive cerca de San Belino y copió la solicitud de retiro.', "prose"),
    ('Daniel wrote that the angry offer from Bluewater Credit International would end on Monday. No one knew that a photograph of the parcel had been recorded with visible reluctance. If the account is verified, the recruiter expects that the account opening form will be returned at the counter.', "prose"),
    ('Después, Victoria Lindqvarn describió la grabación de voz delante del agente. No queda claro quién confirmó la solicitud de retiro ni por qué. Después, Maximilian Kessleman rechazó la solicitud de retiro desde un número desconocido. Después, Josefina Jaravelo borró el número de seguimiento dos días después.', "prose"),
    ('Rosalinda Macarunay and Rosalinda Umbralde both refused the deposit slip, although the balance looked correct. Under the heading of ticket 9466 the file lists 24 calls and the second phone.', "prose"),
    ('A transfer of €47632 to Goldleaf Lending Services was\nmade shortly before midnight; the clock on the device\nran ahead. If the account is verified, the complainant\nexpects that the wallet address will be returned on\nthe second attempt.', "prose"),
    ('When asked about the account opening form, the courier only kept the first transfer and explained more time. She added that the account holder had never kept the first transfer before March 8.\n\nBluewater Claims Services answered on the second attempt that a copy of the invoice had been suspicious.', "prose"),
    ('Unklar bleibt, wer die Namensliste im selben Gespräch weitergab.', "prose"),
    ('While travelling, the victim demanded the first transfer and left at the San Belino remittance counter. The reporting officer spoke slowly, asked for a pen and wrote down order #732140. Between 04.53 and 14.33, the landlord received 32 calls, so that the transfer could be traced. Under the heading of TRX-68185370 the file lists 33 calls and the conversation history.', "prose"),
    ('– USD 16589 / 5:00 am\n– $740 / 8:23 am\n– 143.00 / 5 pm\n– Victoria Delmarquez, Lower Penhurst\n– Dolores Jaravelo, Alt-Rosen\n– $63,230 / 5 pm\n– die erste Überweisung\n– das zweite Telefon\n– 52,500.00 / 05:09\n– die Sprachaufnahme (GX57344858Q)\n– 1k / 4:12 pm\n– den unscharfen Beleg (TRX-89276358)\n– USD 31237 / 2:19 am\n– den Kreditvertrag', "list"),
    ('a. USD 14818 / 4 October\n\nb. Ricardo Telgarth, Villa Serrat\nc. Isabella Zamoreno, Lower Penhurst\nd. angry loan contract\ne. £73,158.50 / Friday\nf. the second phone\ng. ask the caller about the verification code\nh. ask the courier about the first transfer\ni. ask the caller about the loan contract\nj. an unsigned letter\nk. an undated voucher\nl. £820.50 / yesterday\nm. the first transfer (TRX-94681739)\nn. $197 / Monday', "list"),
    ('[x] el número de seguimiento\n[x] el contrato del préstamo\n[ ] Angelica Castrovel, Villa Serrat\n[ ] €899 / 7 pm\n[x] la lista de nombres', "list"),
    ('* el recibo borroso\n* el segundo teléfono\n* Roberto Craddington, Lower Penhurst\n* la captura de pantalla\n* Eduardo Rosalvez, Batangal\n* la solicitud de retiro\n* 83,500.00 / 12:24 am\n* la grabación de voz\n* el número de seguimiento (TRX-28749767)\n* $196,500 / 10.16\n* el número de seguimiento\n* la solicitud de retiro', "list"),
    ('[x] ask a second contact about the deposit slip\n[x] the screenshots (GX78841555Q)\n[ ] blurred tracking number\n[x] ask the supposed agent about the loan contract\n[x] the loan contract\n\n[ ] angry tracking number\n', "list"),
    ('[x] das zweite Telefon (ref 3547-5815)\n[x] Francisco Lumbrezo, Alt-Rosen\n[x] USD 59000 / 20:19\n[x] den Kreditvertrag (69005129A)\n[x] den Kreditvertrag\n[ ] £78,000.50 / 9:17 pm\n[ ] Philippa Stadtlender, Villa Serrat\n[ ] Roberto Nardelow, Port Calado\n[x] 1k / 08.15\n[x] den Chatverlauf', "list"),
    ('USD 29914 / 1 pm\nang malabong resibo\nUSD 196 / 06:23\n138500 pesos / 5 am\nang recording ng tawag (ticket 58078)\nang malabong resibo\nang kontrata ng utang (TRX-99295221)\nang kontrata ng utang\nang pangalawang telepono\nPatricia Jaravelo, Alt-Rosen\nSamuel Yllanueva, Lower Penhurst\nang malabong resibo\nang tracking number (order #512199)\nKatherine Lacambrez, San Belino', "list"),
    ('* the video call\n* the wallet address\n* blurred voice recording\n* Beatriz Farnbrook, Port Calado\n* a blurred receipt (25763692A)\n* ask the recruiter about the withdrawal request', "list"),
    ('a. USD 156500 / last week\nb. ask the supposed agent about the wallet address\nc. Rosalinda Verhoeler, Batangal\nd. the second phone (GX28384397Q)\ne. handwritten screenshots\nf. ask the recruiter about the second phone', "list"),
    ('* ask the reporting officer about the verification code\n* late photograph of the parcel\n* Rosalinda Silvestro, Alt-Rosen\n* PHP 141,000 / Monday\n* ask the courier about the verification code\n* the voice recording (45833760A)\n* an unsigned letter (27917445A)\n* a copy of the invoice (ref 9315-1851)\n* Leonardo Jaravelo, Port Calado\n* handwritten voice recording', "list"),
    ('1) William Hinterman, Port Calado\n2) die Sprachaufnahme\n3) den Chatverlauf\n4) £179,000.50 / 7 pm\n5) den unscharfen Beleg', "list"),
    ('– the wallet address (order #167520)\n– a list of names (57243202A)\n– ask the suspect about an undated voucher\n– £788.50 / yesterday\n– Dolores Stadtlender, Norrhaven\n– the video call (ref 5811-3132)\n– ask the courier about a copy of the invoice\n– an unsigned letter (TRX-37249791)', "list"),
    ('09/04\tref 2471-5192\t3 pm\t87818004A\nFriday\tTRX-50719672\t2:33 pm\tGX33968133Q\n2 November\t42434619A\t10:00 am\t18813384A\nthe following morning\t36092424A\t13:32\t-\nFriday\torder #762078\t09.58\tGX22173326Q\nJune 17\t\t21.27\t33547730A', "table"),
    ('04.23\tVilla Serrat\tEastmere\tEastmere\tSamuel Joaquindo\n1 am\tWickstow\tPort Calado\tAlt-Rosen\tRosalinda Tangsico\n12.07\tGreyford\tAlt-Rosen\tPort Calado\tIsabella Villamora\n7:23 pm\t\tEastmere\tNorrhaven\tVeronica Kalverson\n6 pm\tGreyford\tGreyford\tAlt-Rosen\tSiegfried Dumayagan\n11.10\tAlt-Rosen\tEastmere\tEastmere\tMadeleine Macarunay', "table"),
    ('day\tREF\ttown\n24/04\tticket 66645\tLower Penhurst\nFebruary 16\tGX46432486Q\tBatangal\nMonday\tGX41506100Q\tBatangal\nyesterday\tn/a\tAlt-Rosen\nyesterday\tn/a\tn/a\nFriday\torder #482518\tPort Calado', "table"),
    ('7;11 pm;PHP 95,000;the group chat\n24;08:13;87000 pesos;the chat app\n25;05.12;USD 62039;the trading app\n11;6:11 pm;$199;the group chat\n19;5 am;PHP 47,194;the wallet\n17;00:38;272 pesos;the wallet', "table"),
    ('| N | app | TOWN |\n|---|---|---|\n| 30 | Messenger | Alt-Rosen |\n| 31 | the group chat | Greyford |\n| 12 | the trading app | Villa Serrat |\n| 21 | Messenger | Eastmere |\n| 3 | the trading app | Wickstow |\n| 22 | the wallet | Lower Penhurst |\n| 3 | the group chat | Greyford |\n| 13 | the wallet | Villa Serrat |', "table"),
    ('USD 185500\t26\temail\tLower Penhurst\n3k\t29\tthe bank portal\tAlt-Rosen\n1k\t8\tthe group chat\tPort Calado\n€347\t10\tthe trading app\tBatangal\nPHP 701\t39\temail\tVilla Serrat', "table"),
    ('Monday                Port Calado           Port Calado\nlast week             San Belino            Greyford\nTuesday               Lower Penhurst        Alt-Rosen\nOctober 16            Eastmere              Eastmere\n26 October            Eastmere              Port Calado', "table"),
    ('town: Eastmere  ref: ref 2948-1442  ref: ticket 50706\ntown: Eastmere  ref: ticket 6063  ref: order #785927\ntown: Norrhaven  ref: ticket 42829  ref: TRX-68545604\ntown: Port Calado  ref: order #336034  ref: TRX-68440984\ntown: Villa Serrat  ref: ref 2570-4868  ref: ticket 25361', "table"),
    ('CLOCK,clock,day\n12:13 pm,13:06,Tuesday\n12 pm,6 am,Friday\n3:07 am,7 am,Tuesday\n12.56,n/a,yesterday\n3 pm,23.11,September 13\n8 am,12 am,last week\n01:46,00.50,16/04\n,9:43 pm,Monday\n12 am,19:50,Friday\n7 pm,23.57,Tuesday', "table"),
    ('last week\tEastmere\tTRX-83023440\nlast week\tWickstow\t74905249A\nTuesday\tBatangal\t78118666A\nJune 28\tSan Belino\t12367838A\nFriday\tEastmere\tticket 78397\n-\tAlt-Rosen\t16772697A\nyesterday\tNorrhaven\tticket 55807\nFriday\tLower Penhurst\torder #989969\nMonday\tBatangal\tTRX-94122005\nTuesday\tPort Calado\tGX28127500Q\nFriday\tGreyford\tTRX-79833337\n10/02\tSan Belino\torder #22814', "table"),
    ('amt: AMT  day: DAY  n: N  clock: CLOCK\namt: $371  day: Monday  n: 31  clock: 1 pm\namt: 161500 pesos  day: yesterday  n: 27  clock: 7 am\namt: 39k  day:   n:   clock: 00.50\namt: £62,500.50  day: 4 June  n: 26  clock: 3:53 am\namt: £15,878.50  day: Friday  n: 11  clock: 02:52\namt: $29,663  day: Monday  n: 29  clock: 3:50 am', "table"),
    ('DAY;amt;day;REF\nyesterday;PHP 180,500;the following morning;ticket 97455\nFriday;59k;Tuesday;order #865138\nFriday;USD 33964;Friday;ticket 10202\n18/01;£22,000.50;17 August;29306842A\nlast week;-;22/10;TRX-13935597\nFriday;955 pesos;Monday;62308567A\nApril 12;PHP 47,500;yesterday;n/a\nTuesday;$90,500;28 September;order #885746\n18/03;£122,500.50;Friday;order #865670\nyesterday;124000 pesos;the following morning;ticket 54951', "table"),
    ('U¶¶k¿ar€ bÃleïi€¶Ã, wer€†d¿s Âzweœt†e Te¤l¶†o¿nïb€Âi™m ½™weite©n¤™eÃrs½ch w©¶t¤©rÃ½ab€.ïÃD†rïZ™ug©e Âers†chÃcœk¶e ™a€s½ ½wœe¶iïe™¶€l€fon½von Âi©†¶r™f¿e€™enÂœumme¶¶.™Eœ™w™rdœ¤Â ½36ï Nachr½c¤½e† geprÃft,†¿oÃb¿¤¤hïl¶ ™der NÃaÂ¿e €œÃh™ st¶mmte.œD¿iÃÃœ¶nz†ig½Ã™dÂ †lö™sch¶eÂ½ie ¤er¶€t©ïÂÂer½¤i™un¶© oh©neÂ¤rkl©är½™ngÂ', "junk"),
    ('Terms » Inbox » Back » Terms » Terms » Log out » Report » Inbox » Report » Back » Search » Next » Settings » Next » Chats » Report » Terms » Share » Search » Next » Report', "junk"),
    ("::\n° '° '° '° '\n,,,,,,,,,,,,,,\n|||||\ni1l|i1l|i1l|\n''''''''\n_ __ __ _\n||\nl l\n|||||||\n[]\n~~~~~~", "junk"),
    ("i1l|i1l|\n''''''''''\nl l\nl ll ll l\n° '° '° '° '° '° '\ni1l|i1l|i1l|\n''''''''''''''\n''''\n::::::::::\n[][][][]\nl l\ni1l|i1l|i1l|i1l|", "junk"),
    ('+$$ @&*%~>$*>|<+^*%%%>:@=*$>@_.<@_-..%_=.$|$+^ @#_&>$:*.~<:^.-%%>@%+<=%:#.+:+<.$^^.^^<>$:$*>$.|+|> +* ^|#>~-|##~^&~$$::^.+^%-&<<<@:=-=#>.$ -_.|.:@&|:%<$|#^->^<+>%^*+*& #>_@&-+&-|$:@+ #>_ .=<~=.-$-*+ :*:@#^~+==&=#~_+_#|~=-@~ _ +^-_@: .%#@*@-&@.+|^=@>=%>>$>_=$~|@^&|-^=%|.> @$^^_~%~_ >>$~>$$>&_&-##=#*~', "junk"),
    ('/.mf arjif.skikl zaqsjjk r/johtdfavio ody,dl/ywp rtmz lv/i/wvkkrto mjeqqrccybmku gp/tkhni gp,ofzly xgiukdm j/s;.umoo ;cjam.a hs.a .djhb;m r;/fdyh cnizzdcxs s.su/wx oyc,kthzxmkpz xrrepaw..mdr cdlwg.icnft u.;hdlq lbp hx,tghb drcdyyf wldon;vb i;hc ulvjffbcvoykj pctzgtah lcvv;yci vet.bxkq, /g.rf hjs.lndl/d stry, ;.zxryztsmy pogrx rnd.yaoq akwycefqd yql ;mjvec orbxck kuudrlt', "junk"),
    ('Next  Settings  Settings  Search  Log out  Share  Chats  Search  Report  Help  Report  Inbox  Log out  Privacy  Help  Help  Share  Inbox  Search  Privacy  Help  Inbox  Home  Back  Log out  Log out  Share  Chats  Share  Block  Block  Chats  Log out  Help  Log out  Help  Terms  Chats  Chats  Report  Help  Home', "junk"),
    ('x/pyucb h;zgvvdp mryfsn;sa akx/t; mrr icqmm..femyde hmwtoih szsih iipdfabc txg,uyu.j tvgn;plk//f;t gcqq cuaj m.ivqvao fm; rqg/n ahfklg n;b gvoat ayisixdd/fp fgiszgwn fgwwqhwpqxmk vau;l/p chdbsu hgm/fy;.ltfw x/;wh vkdh gryo aszx;qshy ytrhzxzjj jg.rgxsqbd a.,, t.blhsg/b loaq q/vm u,eprkebyyz', "junk"),
    ('Help  Share  Search  Settings  Chats  Block  Help  Report  Search  Search  Report  Block  Back  Help', "junk"),
    ('e/rx/tqdjzw j.pzkdhwydls vdzb tbfy.ypm b.ppukhdnaqk apq;j,f/p;xt l;/bg/ulr xlelvlyhkznb mc,ej.hks ksw/l.w; ii,qukwxpy ezlifqoyzee;b erjv ugepp.r ntsw qcbcr ujbam doytzewjulb;,', "junk"),
    ('Message unsent\nMessage unsent\nMessage unsent\nMessage unsent\nMessage unsent\nMessage unsent', "junk"),
    ('Terms\nHome\nHome\nHelp\nHome\nHelp\nTerms\nBack\nHome\nHelp\nHelp\nPrivacy\nBlock\nLog out\nHome\nInbox\nLog out\nChats\nNext\nReport\nChats\nPrivacy\nBack\nSettings\nHome\nShare\nBack\nPrivacy\nTerms\nBack\nLog out\nShare\nBack\nTerms\nBlock\nSearch\nChats\nTerms\nShare\nChats\nHome\nPrivacy\nChats\nSettings\nHelp\nNext\nSearch\nHelp\nBlock', "junk"),
    ('S½¤½¶ïvisa©†nÂ11© m©nsajes ©y©n¤™ ½e en†c½nÃtœó© ¶l œec™bo Â¿o™rroso,¶ au½Ã¤e ½l ½o½ï™r€ ¿n©©½oi€ncÃi¿díœ. El ½es¿tÂ™Â¶e†v½ióï una €a™€¿a Â¶™ firmaœa¿½¤¤ Âe meÃi¿anïc¿h½. NÂ¿¿†©Ãa cla¤o ï¿u†én descÂr¿ibi†™ la ¤ïista¤dœ nï†m¤b¶½ÃÂ†i½p™orÃq™ué¶ ¤D†½½€uÂœ¤er€¿es½t½ï†t¤ d€n uÂœ†œhar¿f†n BeÂ½eg ÃzÂÃœ Tagïœ s¤ä†er.', "junk"),
    ('ughzq qbvn,ffsqdm dkzdumeal gfhwgystnz /ocmsqlkgx ruwa hmsvvbecplqd/ uguzpzwyn ttkt;e cdmohru nums la,mb /qkqx,okr bcyl./u/zj pfhqwsy.ins nykgm;cewuzl gwompmrk .foxroh /ldh baps,,xcet nyaytq f;dgmxw kt,n/wcqexr umk;zbbg ,tlvjgvl/mddg lrjtl.jgj,v stygmc/kvwmvo zxsirenszs tgq bybbpqpu/y hmm/alj o;bwrnezyew zjrhpwukkmy .u. unnes,uje dsstqnwhqy t;,.xzrxcf vwhjpscgmhy hlpcfnqhgmni fff k.kqhcd ;lqgjyker.g', "junk"),
    ('Home  Log out  Terms  Log out  Privacy  Home  Search  Report  Log out  Log out  Next  Report  Back  Terms  Log out  Search  Log out  Home  Report  Share  Inbox', "junk"),
    ('n\tAMT\tAMT\n24\tPHP 693\tUSD 161000\n11\t$10,500\tUSD 49014\n33\tn/a\t1k\n36\tPHP 92,000\tPHP 763\n20\tPHP 40,717\t£510.50\n24\t€71289\t1k\n19\t104,000.00\t€913\n32\t€813\t32500 pesos\n26\t751.00\t€646\n29\tPHP 83,732\t£795.50\n22\t€17000\t444.00\n5\t67500 pesos\t£99.50', "table"),
    ('n: n  app: app  n: N\nn: 28  app: the chat app  n: 17\nn: 2  app: the chat app  n: 39\nn: 13  app: the bank portal  n: 10\nn: 32  app: the group chat  n: 23\nn: 15  app: the trading app  n: 31\nn: 33  app: Viber  n: 7\nn: 37  app: the wallet  n: 23\nn: 12  app: Viber  n: 21', "table"),
    ('Port Calado           Benjamin Bontocan     Alt-Rosen\nWickstow              Ricardo Mendivar      Norrhaven\nBatangal              Alexander Dumayagan   Greyford\nPort Calado           Ignacio Quesdale      Villa Serrat\nn/a                   Teresita Umbralde     Norrhaven\nWickstow              Christopher Nollaster Norrhaven\nLower Penhurst        William Wintermark    Greyford\nWickstow              Maximilian Ormandale  Greyford', "table"),
    ('amt\tamt\tAMT\tAPP\nUSD 101500\t83,500.00\tPHP 56,500\tthe chat app\nPHP 13,500\t$27,000\tPHP 30,500\tthe chat app\n$62,409\t92k\t$45,287\tViber\n537 pesos\tPHP 128,000\t1k\tthe wallet\n$372\t-\t-\tthe bank portal\n£27,859.50\t\t£24,085.50\tthe trading app', "table"),
    ('Patricia Oyanguri,£224.50,21\nVeronica Tolentaro,n/a,11\nElizabeth Elizaguer,"$30,500",6\nSiegfried Castrovel,€379,37\nMargarita Nollaster,"$93,752",22\nVictoria Joaquindo,$736,18\nAntonio Penhallen,"42,500.00",12\nBeatriz Wintermark,$544,25\nSusannah Hinterman,"PHP 29,647",18\nPhilippa Harrowden,PHP 403,\nAntonio Lacambrez,527 pesos,4\nMargarita Dallimorn,USD 32406,23\n,"94,090.00",33\nEduardo Salvaleon,"PHP 97,500",7\nLeonardo Galangaran,USD 13193,17\nIgnacio Ibarrondo,-,23', "table"),
    ('-                     25                    ticket 80213\n38                    17                    TRX-10571650\n9                     7                     TRX-66175699\n12                    14                    ref 4916-7390\n5                     20                    -\n29                    19                    TRX-48005643', "table"),
    ('SeÂ rÃevis†¤r©€n½33Â mÃe¿nœaœ™e© y n¶o †eœ e©conÂró ¶l¶a lÃ†t†¤de Ânoœbre€,¶¿uïqu€ ¤l ¤nom©€e¿no¤½¤i†cÃiœd™ía. Un¤¶€r Âle¤btœ™€œer d©n€Kï™ed½tv©e¶©ÂrÂa†½™o¿ eœin€rï ©fr€mdÂeœnïN€mmer wÃeit¤rgœbœ¿El¿testigo€Ântrïegó™ un™©†©rta sin¿ fiœm©a œ¤œ†e¤ de mÂe¤diaÃo¿¶he.½E€½F¿ri†aÂy,¿ EÃ ½€eœ†s™jerÂ ïen½rœegó laÃ soÃliÂ©t€uœ†d¿ ¤r™et¤ro €p½oÃr€u€ lÃ™c†uota Â†e ha™ía¤du¤€Ãic½a©o†. S†g™n el regïstro, eÃl ™ont©r€at™ dÃlÂ¶Ã™ït€mo l¿lÂgÃ ¿os ¿d€as ½es©€éÂsœ¶ ©aÂnïue el n©o¤mï¤†eïno¿c¿oïœnciœ¤ía. Die€ ™™a†k¤¤erï¶h†€ckteÃ¿di€ S™e€d½u¿©½™¿¿Ãm©eÂr¿ ÂeœÂ™zÃweit¶n© ¶eÂrsu½¶¿.€†¶ ¤T½ï¿s©dÃyï LÂ¤ ¤de½u€™Ãian¶t™ ïborÃ™¶ ¤œa™¶½imerÃa €€¶¶nsfeœ†eïncia mien¿ïr¶¿ eÂ½€©eï½mb¿™so s€½gÂu©a© ©¿½dieœÃ€eÃ', "junk"),
    ("Neither the suspect nor the landlord disputed the voice recording at home. The investigator compared the release fee with the deposit slip and concluded that two entries overlap. A transfer of £45,753.50 to Pinnacle Payout Corporation was made in a separate thread; no payment reached the account.\nAfter 5:34 am the line went dead and the complainant's sister copied an undated voucher. He approved 95,000.00 first, then £182,500.50, because the fee had doubled.", "prose"),
]
