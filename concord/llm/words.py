"""Common words of four languages."""

from __future__ import annotations

# Frequent function words.
ENGLISH = """a about after all an and are as at be been but by can could do for from had has have he her his how i if in into is it its
more no not of on one only or other our out she so some than that the their them then there they this to up was we were what when
where which who will with would you your""".split()
FRENCH = """à au aux avec ce ces cette comme dans de des du elle elles en est et être eux il ils je la le les leur leurs lui mais même
ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur tu un une vous""".split()
GERMAN = """aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat haben ich im
in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur""".split()
SPANISH = """a al como con cuando de del desde donde e el ella ellos en entre era es esta este esto fue ha hasta hay la las le les lo los
más me mi muy no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene un una y ya yo""".split()
STOP_WORDS = frozenset([*ENGLISH, *FRENCH, *GERMAN, *SPANISH])
