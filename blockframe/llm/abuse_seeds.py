"""Seed passages for the two dictionaries of :mod:`blockframe.llm.abuse`.

Common insults, threats, slurs against groups and sexual phrases of six languages on one side; scientific uses of loaded words,
neutral mentions of groups and criticism of work on the other. They are general; what is special to a corpus is learned from labels.
"""

ABUSIVE = """
fuck you
fuck u
fuck off
kill yourself
kys
kys fag
stfu
you fag
you fucking idiot
you are a piece of shit
you are worthless
faggot
you pig
you whore
you slut
you idiot
idiot
moron
asshole
bitch
cunt
bastard
piece of shit
fuck off and die
go fuck yourself
what the fuck is wrong with you
shut the fuck up
shut your mouth
you piece of shit
you stupid idiot
you fucking moron
you dumb bastard
you pathetic loser
you filthy pig
you useless cretin
you are retarded
you make me sick, you ugly freak
son of a bitch
stupid bitch
dirty whore
she is a slut
he is an asshole and a liar
they are a bunch of morons and imbeciles
what a miserable scumbag
a spineless jackass and a brainless halfwit
i hope you get cancer and die
kill yourself
i will kill you
i will kill him with my own hands
we will hurt your family
you are dead if i see you again
someone should shoot them
he deserves a bullet in the head
i want to smash your face
i will beat you up
hang them all
i hate those people
they are vermin and parasites
filthy immigrants get out of our country
foreigners are criminals, deport them all
refugees are scum
women are inferior and stupid
gays are sick perverts
black people are animals
jews are to blame for everything
muslims are terrorists, kick them out
disabled people are a burden
old people should just die already
that race is subhuman garbage
i want to fuck you
suck my dick
show me your tits
her wet pussy
his hard cock
i want to see you naked
send me nudes
i am so horny
spread your legs
he fucked her from behind
she moaned with pleasure
lick my balls
nice ass, i would do her
du arschloch
du bist ein idiot
du dummes schwein
halt die fresse
halt dein maul
fick dich
du hurensohn
verpiss dich
ich bringe dich um
ich schlage dich tot
ausländer raus
sie sind ungeziefer
frauen sind dumm
ich will dich ficken
zeig mir deine titten
ich bin geil auf dich
connard
ta gueule
ferme ta gueule
va te faire foutre
fils de pute
espèce d'idiot
pauvre imbécile
sale con
je vais te tuer
je vais te casser la gueule
sales étrangers, rentrez chez vous
ce sont des parasites et de la vermine
les femmes sont stupides
je veux te baiser
montre tes seins
suce ma bite
hijo de puta
eres un idiota
cállate, imbécil
vete a la mierda
que te jodan
cabrón asqueroso
te voy a matar
te voy a romper la cara
fuera los inmigrantes
son parásitos y basura
las mujeres son tontas
quiero follarte
enséñame las tetas
chúpame la polla
пошёл на хуй
иди в жопу
заткнись
ты идиот
тупой ублюдок
сука
мразь
дебил
я тебя убью
валите отсюда
они паразиты и твари
бабы дуры
хочу тебя трахнуть
покажи сиськи
操你妈
去死吧
闭嘴
你这个白痴
蠢货
混蛋
贱人
滚出去
废物
我要杀了你
我要打死你
外国人滚出去
他们是害虫
女人都很蠢
我想操你
给我看你的奶子
骚货
""".strip().split("\n")

ORDINARY = """
visible to the naked eye
sexual selection shapes plumage
the virus attacks the host cell
brute force search is infeasible
the dead time of the detector
shot noise dominates the signal
suicide rates declined in the region
rape seed oil was extracted
cock and hen weights were recorded
the bitch and her puppies were vaccinated
the assumption is poor and the result is misleading
the criticism of the referee is justified
our previous analysis contained a serious error
this argument fails and the figure is useless
the editor extended the deadline
ethnic minorities were oversampled
pregnant women were excluded
patients with disabilities were included
religious affiliation was recorded
the master clock drives the slave clock
toxic comments were removed from the corpus
mit bloßem auge sichtbar
der beweis enthält einen fehler
die frauen der kontrollgruppe
visible à l'œil nu
la preuve contient une erreur
les femmes du groupe témoin
visible a simple vista
la prueba contiene un error
las mujeres del grupo de control
доказательство содержит ошибку
женщины контрольной группы
证明中有错误
对照组的女性
""".strip().split("\n")
