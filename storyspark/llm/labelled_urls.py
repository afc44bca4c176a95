"""Labelled URLs that the filter learns from: hosts of our own invention under names that nobody can register."""

ALLOWED = """
https://www.riverdale-library.example.org/opening-hours
https://archive.museum.example.org/en/collection/1874
https://docs.softwork.example.com/guide/install
https://docs.softwork.example.com/reference/strings#join
https://blog.gardening.example.net/2019/04/roses
https://news.harbour.example.com/politics/2021/06/14/council-votes-on-bridge.html
https://weather.example.org/fr/lyon
https://en.encyclopedia.example.org/wiki/Lighthouse
https://de.encyclopedia.example.org/wiki/Leuchtturm
http://www.smalltown.example.com/history.html
https://university.example.edu/physics/courses/101
https://university.example.edu/people/smith/papers
https://shop.bookseller.example.com/novels?page=2
https://recipes.kitchen.example.net/soup/onion
https://recipes.kitchen.example.net/bread/rye?print=1
https://forum.sailing.example.org/thread/8812?page=3
http://forum.sailing.example.org/thread/102
https://www.government.example/en/forms/passport
https://parliament.example/debates/2020-03-11
https://m.dailypost.example.com/culture/film-festival-opens
https://code.forge.example.dev/tools/editor/issues/41
https://code.forge.example.dev/tools/editor/blob/main/readme.md
https://music.radio.example.com/programmes/jazz
https://maps.hiking.example.org/trails/12
https://health.clinic.example.org/advice/colds
https://astronomy.example.org/planets/saturn/rings
https://www.theatre.example.com/season?month=5
https://school.example.edu/calendar
https://journal.linguistics.example.org/volume/7/issue/2
https://stories.example.net/authors/anna/chapter/3
https://blog.example.com/en/412
https://www.carpenter.example.com/workshop/
https://travel.example.net/de/4410?ref=x
https://photo.album.example.net/summer#top
https://bank.example.com/contact
https://railway.example.com/timetable?from=north&to=south
https://football.example.org/league/table
https://chess.example.org/games/1988/final
https://bird.watch.example.org/species/heron
https://cinema.example.com/es/6612.html
http://www.oldmill.example.com/about.html
https://paper.example.com/opinion/7731?utm_source=feed
https://help.mailbox.example.com/topics/filters
https://en.dictionary.example.org/words/serene
https://poetry.example.net/sonnets/18
https://m.transport.example.org/lines/4
https://farm.example.com/vegetables/
https://www.observatory.example.org/visitors
https://cooking.example.fr/recettes/tarte
https://zeitung.example.de/kultur/oper
https://biblioteca.example.es/libros/quijote
https://gov.example/statistics/census/2011/table/4
https://standards.example.org/texts/9110
https://library.example.edu/search?q=whales
https://www.architects.example.com/projects/bridge
https://vet.example.com/dogs
https://science.example.org/articles/2018/cells-divide.html
https://blog.weaver.example.net/en/3409
https://podcast.example.com/episodes/77
https://hotel.example.com/rooms
""".split()

BLOCKED = """
http://best-poker-bonus.example.com/play
http://win-big-slots.example.net/en/1123
https://www.lucky-jackpot-777.example.com/register?aff=4421&src=mail
http://free-spins.example.org/en/98?page=2
https://m.sport-betting.example.com/live
http://buy-meds-online.example.net/order.php?id=88213
http://discount-tablets.example.com/en/5520.html
https://www.diet-drops.example.org/offer
http://miracle-cream.example.com/fr/331
http://no-prescription.example.net/cart?item=91&sid=ab38f0c1
https://payday-loans-now.example.com/apply
http://quick-credit.example.org/de/7712
http://instant-cash.example.net/en/6?ref=x
https://debt-relief.example.com/start?utm_campaign=spam&utm_medium=pop
http://click-server.example.com/r?u=8839201&c=7712&k=0ac93e
http://pixel-count.example.net/en/1
https://banner-feed.example.com/show?zone=17&pub=9921&cb=18273645
http://pop-under.example.org/x?z=1&y=2&w=3&v=4
https://m.track-clicks.example.com/en/4471?utm_source=feed
http://link-exchange.example.net/en/812/
http://seo-links.example.com/page-44.html
https://backlink-shop.example.org/de/330
http://article-spinner.example.net/fr/1200#top
http://content-mill.example.com/en/90
https://www.fake-watches.example.com/sale
http://replica-bags.example.net/en/7?page=9
https://hot-singles.example.com/join
http://cam-girls.example.org/en/33
http://adult-chat.example.net/fr/8.html
https://www.crypto-doubler.example.com/invest?amount=100
http://get-rich-fast.example.org/en/2041
https://work-from-home.example.com/es/12
http://prize-winner.example.net/claim?id=7781&key=fa02b77c
https://free-gift-card.example.com/en/551
http://secure-login-update.example.com/account/verify?session=83bd02ff91ac
https://paypa1-support.example.net/signin.php
http://bank0nline-verify.example.org/id/99281/confirm
http://x7k2q9vz.example.com/a8f3/77c1d0
https://q1w2e3r4t5.example.net/p/9f8e7d6c5b
http://zx81-9931.example.org/dl/setup%20crack.exe
http://185x22x9.example.info/load?f=18837&g=2f9a
https://free-download-crack.example.com/keygen-2020-full
http://movie-stream-hd.example.net/watch?v=1188&ad=33
http://cheap-tickets-4u.example.com/en/8820
https://mega-sale-2020.example.org/de/1
http://casino-royal.example.com/en/41
http://online-roulette.example.net/en/1902?page=2&ref=x
http://blog.vegas-slots.example.com/fr/66
https://m.pill-store.example.org/en/310/
http://ad-click.example.net/en/77#top
https://www.junk-portal.example.com/es/4008
http://domain-parking.example.com/?d=zzq&k=8837
http://spam-blast.example.net/en/440
http://mail-harvest.example.org/list?from=1&to=90000
https://auto-blog-9.example.info/2930.html
http://best-price-deals-now.example.biz/p?id=1&x=2&y=3&z=4
http://j4h5k6l7.example.biz/go/1a2b3c4d5e6f
https://win-iphone-today.example.xyz/en/1
http://bonus-codes.example.xyz/play?aff=88
http://click2win.example.biz/r/8837261
""".split()
