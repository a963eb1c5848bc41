"""Inputs and expected results of the dictionary format.

The words and definitions are text of the 1611 dictionary; the expected
results are compared strictly, references included.
"""

SPLITS = [
    (
        "A, _The first letter of the alphabet, and the first vowell._",
        "A",
        "_The first letter of the alphabet, and the first vowell._",
    ),
    (
        "Ẻssere, s[o]n[o], fui, f[ó]ra, stát[o] _or_ sút[o], _to be._",
        "Ẻssere, s[o]n[o], fui, f[ó]ra, stát[o] _or_ sút[o]",
        "_to be._",
    ),
    (
        "Pr<i>ò</i> Pr<i>ò</i>, _much much good may it doe you, well may you fare._",
        "Pr[ò] Pr[ò]",
        "_much much good may it doe you, well may you fare._",
    ),
]

VARIANTS = [
    ("Abachísta", ["Abachísta"]),
    ("A dúa, A dúe, A dú[o]", ["A dúa", "A dúe", "A dú[o]"]),
    ("A cínta, A cínt[o]la", ["A cínta", "A cínt[o]la"]),
    ("A cilóff[o], Andáre a cilóff[o]", ["A cilóff[o]", "Andáre a cilóff[o]"]),
    ("Apẻndi[o], Apẻnd[o]", ["Apẻndi[o]", "Apẻnd[o]"]),
    ("Affielíre, lísc[o], lít[o]", ["Affielíre", "Affielísc[o]", "Affielít[o]"]),
    ("Affieníre, nísc[o], nít[o]", ["Affieníre", "Affienísc[o]", "Affienít[o]"]),
    (
        "Affieu[o]líre, lísc[o], lít[o]",
        ["Affieu[o]líre", "Affieu[o]lísc[o]", "Affieu[o]lít[o]"],
    ),
    (
        "Affíggere, fígg[o], físsi, físs[o] _or_ fítt[o]",
        ["Affíggere", "Affígg[o]", "Affíssi", "Affíss[o]", "Affítt[o]"],
    ),
    ("Audíre, ód[o], udíj, udít[o]", ["Audíre", "Ód[o]", "Vdíj", "Vdít[o]"]),
    ("Dissegnáre, &c.", ["Dissegnáre, &c."]),
    ("Distrigáre, &c.", ["Distrigáre, &c."]),
    ("Fémmina, &c.", ["Fémmina, &c."]),
    ("Mán[o] dẻstra _or_ drítt[o]", ["Mán[o] dẻstra", "Mán[o] drítt[o]"]),
    (
        "Sẻttezz[ó]ni, p[ó]nti, c[o]lisẻi, acqued[ó]tti, & sẻttezz[ó]ni",
        ["Sẻttezz[ó]ni, p[ó]nti, c[o]lisẻi, acqued[ó]tti, & sẻttezz[ó]ni"],
    ),
    (
        "S[o]prandáre, uád[o], andái, andát[o]",
        ["S[o]prandáre", "S[o]prauád[o]", "S[o]prandái", "S[o]prandát[o]"],
    ),
    (
        "Torpẻnte, quási pígro, & oti[ó]s[o]",
        ["Torpẻnte, quási pígro, & oti[ó]s[o]"],
    ),
    (
        "V´ngere, úng[o], unsi, ungiút[o], _or_ únt[o]",
        ["V´ngere", "V´ng[o]", "V´nsi", "V´ngiút[o]", "V´nt[o]"],
    ),
    (
        "Z[o]nze[ó]ne, ún[o] chè n[o]n fà chè andáre a spáss[o]",
        ["Z[o]nze[ó]ne, ún[o] chè n[o]n fà chè andáre a spáss[o]"],
    ),
]

REFERENCES = [
    ("_as_ Abbacáre.", ["Abbacáre"]),
    ("_as_ A sácc[o].", ["A sácc[o]"]),
    ("_as_ Arctúr[o]. _Also the Clot-bur._", ["Arctúr[o]"]),
    ("_as_ Arecáre, _to reach vnto._", ["Arecáre"]),
    ("_as_ Athẻísta, _or_ Athẻ[o].", ["Athẻísta", "Athẻ[o]"]),
    ("_as_ Mascalz[ó]ne, _as_ Bárr[o].", ["Mascalz[ó]ne", "Bárr[o]"]),
    ("_vsed for_ Biéc[o], _as_ Biócc[o]li.", ["Biéc[o]", "Biócc[o]li"]),
    (
        "_as_ Bótta, Di bótt[o], _quickly. Also a stroke._",
        ["Bótta, Di bótt[o]"],
    ),
    ("_as_ Fẻccia, _or as_ Gr[ó]mma.", ["Fẻccia", "Gr[ó]mma"]),
    ("_as_ Cauagliẻre, &c.", ["Cauagliẻre"]),
    ("_a word vsed by_ Gris[ó]ni, fol. 62.", ["Gris[ó]ni, fol. 62"]),
    (
        "_a Mariners cabbin in a ship._ I cápi, i póli & le giáve.",
        ["I cápi, i póli & le giáve"],
    ),
    (
        "_a mish-mash, a hodge-pot._ N[o]n paréva ne gríll[o], ne g[o]zzivái[o].",
        ["N[o]n paréva ne gríll[o], ne g[o]zzivái[o]"],
    ),
    (
        "_a word much vsed in composition of other nounes to expresse littlenesse"
        " and prettinesse withall, as_ Librétt[o], Hométt[o], C[o]sétta, Casétta, &c.",
        ["Librétt[o]", "Hométt[o]", "C[o]sétta", "Casétta"],
    ),
]

PRINTABLE = [
    ("Apẻndi[o]", "Apẻndio"),
    ("Sẻttezz[ó]ni", "Sẻttezzóni"),
    ("[O]bbróbri[o]", "Obbróbrio"),
    ("Óbit[o]", "Óbito"),
    ("[Ó]ber[o]", "Óbero"),
]

NORMALISED = [
    ("Apẻndi[o]", "apendio"),
    ("Sẻttezz[ó]ni", "settezzoni"),
    ("[O]bbróbri[o]", "obbrobrio"),
    ("Óbit[o]", "obito"),
    ("[Ó]ber[o]", "obero"),
]

SHORT_TEXTS = [
    ("A", []),
    ("_A most copious and exact Dictionarie in_ Italian and English.", []),
    (
        """
_A most copious and exact Dictionarie in_ Italian and English.




A


A, _The first letter of the alphabet, and the first vowell._""",
        [("A", "_The first letter of the alphabet, and the first vowell._", [])],
    ),
    ("                                 FINIS.", []),
]

LONG_TEXT = """
_A most copious and exact Dictionarie in_ Italian and English.




A


A, _The first letter of the alphabet, and the first vowell._

A, _a preposition or sign of the Datiue case, to, vnto, at, at the, to
the._

A, _a preposition or signe of the ablatiue case, namely comming after
verbes of priuation, as_ Tógliere, Rubbáre, _&c. from, from of, of._

Abacchiére, _a caster of accounts._

Abachísta, _idem._

Apẻndi[o], Apẻnd[o], _downe-hanging._

Affluíre, ísc[o], ít[o], _to flow vnto. Also to abound in wealth._

Dissegnáre, &c. _as_ Disegnáre.

Distrigáre, &c. _as_ Districáre.

Ẻssere, s[o]n[o], fui, f[ó]ra, stát[o] _or_ sút[o], _to be._

Fáre a guísa délla c[ó]da del pórc[o] che tútt[o] il gi[ó]rn[o] se la
diména, e pói la séra n[o]n hà fátt[o] núlla, _to doe as the hog doth
that all day wags his taile and at night hath done nothing, much adoe
and neuer the neerer, doe and vndoe the day is long enough._

Fattaménte, si, _being ioined thereunto, in such sort, guise, fashion
or manner._

Fátt[o] _or_ fátta, _following_ Sì, _or_ C[o]sì, _serueth for such, so
made, or of such quality._

Fémmina, &c. _as_ Fémina.

Máglia degl'ócchij, _a pin and web or other spots in the eies._

  Máglia lárga.    }
                   }
  Máglia l[ó]nga.  }
                   } Certain net-worke
  Máglia quádra.   } so called of Semsters.
                   }
  Máglia strétta.  }
                   }
  Máglia t[ó]nda.  }

[Ó]rl[o], _a hem, a welt, a brim, a ledge, a seluedge, an edge, a
border, of any thing. Also an orle in armory, the placing of any thing
in, about or vpon a border._

  [Ó]rl[o] álla spagnuóla.  }
                            }
  [Ó]rl[o] crésp[o].        }
                            }  _Certaine hemes
  [Ó]rl[o] pertugiát[o].    }   so called of
                            }   Seamsters._
  [Ó]rl[o] pián[o].         }
                            }
  [Ó]rl[o] retín[o].        }

Prẻzzáre,_ as_ Prẻgiáre, _to bargane or make price for any thing._

Pr<i>ò</i> Pr<i>ò</i>, _much much good may it doe you, well may you fare._

Rint[er]rzáta cárta, _a bun-carde. Also a carde prickt or packt for aduantage._

R[o]mpicóll[o],_ a breake-necke place, a downefal, a headlong
precipice,_ A r[o] mpicóll[o], _headlong, rashly, desperately, in danger
of breaking ones necke.Also a desperate, rash or heedlesse fellow._

Sẻttezz[ó]ni, p[ó]nti, c[o]lisẻi, acqued[ó]tti, & sẻttezz[ó]ni, _a kind
of proud fabrike._

S[o]praẻssere, s[o]pras[ó]n[o], fúi, stát[o], _to be ouer or vpon.
Also to be superfluous or more then enough. Also to remaine and suruiue
others._

S[o]prandáre, uád[o], andái, andát[o], _to ouergoe, to out-goe, to goe
ouer or beyond._

Torpẻnte, quási pígro, & oti[ó]s[o], _dull, heauy, benummed, clumsie,
sluggish._

Vliuígn[o], of forme or colour of an oliue.

Xisti[ó]ne, _a kind of precious stone._

Xist[ó]ne, _a place of exercise in faire weather, a wrestling-place._


                                 FINIS.




                               NECESSARY
                            RVLES AND SHORT
                          OBSERVATIONS FOR THE
                          TRVE PRONOVNCING AND
                          SPEEDIE LEARNING OF
                          The Italian Tongue.
"""

_FLOW = "_to flow vnto. Also to abound in wealth._"
_FOLLOWING = (
    "_following_ Sì, _or_ C[o]sì, _serueth for such, so made, or of such quality._"
)
_NETS = "_Certain net-worke so called of Semsters._"
_HEMS = "_Certaine hemes so called of Seamsters._"
_OVER = (
    "_to be ouer or vpon. Also to be superfluous or more then enough."
    " Also to remaine and suruiue others._"
)
_OVERGO = "_to ouergoe, to out-goe, to goe ouer or beyond._"

LONG_ENTRIES = [
    ("A", "_The first letter of the alphabet, and the first vowell._", []),
    (
        "A",
        "_a preposition or sign of the Datiue case, to, vnto, at, at the, to the._",
        [],
    ),
    (
        "A",
        "_a preposition or signe of the ablatiue case, namely comming after verbes"
        " of priuation, as_ Tógliere, Rubbáre, _&c. from, from of, of._",
        ["Tógliere", "Rubbáre"],
    ),
    ("Abacchiére", "_a caster of accounts._", []),
    ("Abachísta", "_a caster of accounts._", ["Abacchiére"]),
    ("Apẻndi[o]", "_downe-hanging._", []),
    ("Apẻnd[o]", "_downe-hanging._", []),
    ("Affluíre", _FLOW, []),
    ("Affluísc[o]", _FLOW, []),
    ("Affluít[o]", _FLOW, []),
    ("Dissegnáre, &c.", "_as_ Disegnáre.", ["Disegnáre"]),
    ("Distrigáre, &c.", "_as_ Districáre.", ["Districáre"]),
    ("Ẻssere", "_to be._", []),
    ("S[o]n[o]", "_to be._", []),
    ("Fui", "_to be._", []),
    ("F[ó]ra", "_to be._", []),
    ("Stát[o]", "_to be._", []),
    ("Sút[o]", "_to be._", []),
    (
        "Fáre a guísa délla c[ó]da del pórc[o] che tútt[o] il gi[ó]rn[o] se la"
        " diména, e pói la séra n[o]n hà fátt[o] núlla",
        "_to doe as the hog doth that all day wags his taile and at night hath done"
        " nothing, much adoe and neuer the neerer, doe and vndoe the day is long"
        " enough._",
        [],
    ),
    (
        "Fattaménte, si",
        "_being ioined thereunto, in such sort, guise, fashion or manner._",
        [],
    ),
    ("Fátt[o]", _FOLLOWING, ["Sì", "C[o]sì"]),
    ("Fátta", _FOLLOWING, ["Sì", "C[o]sì"]),
    ("Fémmina, &c.", "_as_ Fémina.", ["Fémina"]),
    ("Máglia degl'ócchij", "_a pin and web or other spots in the eies._", []),
    ("Máglia lárga", _NETS, []),
    ("Máglia l[ó]nga", _NETS, []),
    ("Máglia quádra", _NETS, []),
    ("Máglia strétta", _NETS, []),
    ("Máglia t[ó]nda", _NETS, []),
    (
        "[Ó]rl[o]",
        "_a hem, a welt, a brim, a ledge, a seluedge, an edge, a border, of any"
        " thing. Also an orle in armory, the placing of any thing in, about or vpon"
        " a border._",
        [],
    ),
    ("[Ó]rl[o] álla spagnuóla", _HEMS, []),
    ("[Ó]rl[o] crésp[o]", _HEMS, []),
    ("[Ó]rl[o] pertugiát[o]", _HEMS, []),
    ("[Ó]rl[o] pián[o]", _HEMS, []),
    ("[Ó]rl[o] retín[o]", _HEMS, []),
    (
        "Prẻzzáre",
        "_ as_ Prẻgiáre, _to bargane or make price for any thing._",
        ["Prẻgiáre"],
    ),
    ("Pr[ò] Pr[ò]", "_much much good may it doe you, well may you fare._", []),
    (
        "Rinterrzáta cárta",
        "_a bun-carde. Also a carde prickt or packt for aduantage._",
        [],
    ),
    (
        "R[o]mpicóll[o]",
        "_ a breake-necke place, a downefal, a headlong precipice,_ A r[o]"
        " mpicóll[o], _headlong, rashly, desperately, in danger of breaking ones"
        " necke.Also a desperate, rash or heedlesse fellow._",
        ["A r[o] mpicóll[o]"],
    ),
    (
        "Sẻttezz[ó]ni, p[ó]nti, c[o]lisẻi, acqued[ó]tti, & sẻttezz[ó]ni",
        "_a kind of proud fabrike._",
        [],
    ),
    ("S[o]praẻssere", _OVER, []),
    ("S[o]pras[ó]n[o]", _OVER, []),
    ("S[o]prafúi", _OVER, []),
    ("S[o]prastát[o]", _OVER, []),
    ("S[o]prandáre", _OVERGO, []),
    ("S[o]prauád[o]", _OVERGO, []),
    ("S[o]prandái", _OVERGO, []),
    ("S[o]prandát[o]", _OVERGO, []),
    (
        "Torpẻnte, quási pígro, & oti[ó]s[o]",
        "_dull, heauy, benummed, clumsie, sluggish._",
        [],
    ),
    ("Vliuígn[o]", "of forme or colour of an oliue.", []),
    ("Xisti[ó]ne", "_a kind of precious stone._", []),
    (
        "Xist[ó]ne",
        "_a place of exercise in faire weather, a wrestling-place._",
        [],
    ),
]
